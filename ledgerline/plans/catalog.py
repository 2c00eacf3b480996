"""All registered queries and their SQL."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import rounded
from ..operators.profiles import cluster_sizes, _join
from ..operators.quantiles import label_medians
from . import feature_queries, ingest, ml_queries, profile_queries, robust_queries, score_queries, stream_queries  # noqa: F401
from .oracle import r
from .registry import ORACLES, QUERIES, Data, query

FLAGSHIP = f"""SELECT major_sector, fiscal_year, count(*) AS issuer_years, count(DISTINCT ticker) AS issuers,
 {r('median(scorecard_credit_score)')} AS median_score FROM feat GROUP BY 1,2"""


@query("sector_year_scores", FLAGSHIP)
def _(d: Data) -> DataFrame:
    feats = d.stored_feats()
    keys = ["major_sector", "fiscal_year"]
    out = _join(cluster_sizes(feats, keys), label_medians(feats, keys, ["scorecard_credit_score"]), keys)
    return out.selectExpr(*keys, "issuer_years", "issuers", f"{rounded('median_scorecard_credit_score')} as median_score")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["sector_year_scores"](spark, folder)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
