"""The registered queries: percentiles, packing, leakage, splitting."""

from pyspark.sql import DataFrame, SparkSession

from allelake.llm import daily
from allelake.llm.leakage import leaked
from allelake.llm.packing import pack_texts
from allelake.llm.splitting import LIMIT, OVERLAP, split_texts
from allelake.session import table


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """All speeches in containers of 2,048 tokens; speeches above that as pieces."""
    return pack_texts(table(spark, folder, "documents"), capacity=LIMIT)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Speeches that have passages of evaluation items, with the items."""
    return leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Speeches of more than 2,048 tokens: those that the splitting cuts."""
    return p9_pieces(spark, folder).where("piece_no = 0").select("doc_id")


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of speeches of more than 2,048 tokens, with an overlap of 64."""
    return split_texts(table(spark, folder, "documents"), limit=LIMIT, overlap=OVERLAP, only_oversized=True)


QUERIES = {**daily.QUERIES, "p7_packed": p7_packed, "p8_found": p8_found, "p9_found": p9_found, "p9_pieces": p9_pieces}

#: What SQL can't express (tokens, edit distance) is tested against brute force in tests/llm.
SQL: dict[str, str] = {**daily.SQL}
