"""Paper discovery rows (search-API metadata already landed as a table)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paper_url_derive(api: DataFrame, ids_col: str = "externalIds") -> DataFrame:
    """PDF URL per API row: rows without ids are skipped; an ArXiv id wins
    over an ACL id; rows with neither are dropped."""
    ids = F.col(ids_col)
    url = (F.when(ids["ArXiv"].isNotNull(),
                  F.concat(F.lit("https://arxiv.org/pdf/"), ids["ArXiv"], F.lit(".pdf")))
            .when(ids["ACL"].isNotNull(),
                  F.concat(F.lit("https://aclanthology.org/"), ids["ACL"], F.lit(".pdf"))))
    return (api.filter(ids.isNotNull() & (F.size(ids) > 0))
            .withColumn("pdf_url", url).filter(F.col("pdf_url").isNotNull()))
