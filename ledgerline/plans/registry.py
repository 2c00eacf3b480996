"""Registry of the queries: a Spark callable and, where one exists, the equal SQL."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions.scalars import num, rounded
from ..operators import features as Fe, panel as P
from ..operators.quantiles import median_row
from ..operators.scoring import Model, assign_clusters, score_features
from ..operators.filters import eligible_rows
from ..operators.guardrails import apply_guardrails
from ..operators.outlook import with_outlook
from ..operators.scenarios import score_scenarios
from ..session import drop_folders, stored
from ..sources import filings as S
from .oracle import CENTROIDS, FIRST_YEAR, LAST_YEAR, RANKS, kind, sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(key: str, oracle: str | None = None, extra: dict | None = None):
    def register(fn):
        QUERIES[key] = lambda spark, folder: fn(Data(spark, folder))
        if oracle is not None:
            ORACLES[key] = sql(oracle, extra)
        return fn

    return register


def shape(df: DataFrame, names) -> DataFrame:
    """Select the columns with the rounding used on both sides."""
    return df.selectExpr(*[
        n if kind(n) == "plain" else f"{rounded(n, 2 if kind(n) == 'money' else 6)} as {n}" for n in names
    ])


class Data:
    """Frames derived from the given tables.

    The issuer-year facts, the panel, the engineered panel, the fixed model and the clustered panel are written
    once per session and folder and shared by the queries, as a scoring job
    shares a stored feature table and a stored model.  Files of the folder that
    change in between end the sharing.  `forget()` drops and deletes them.
    """

    shared: dict = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._state: str | None = None

    @property
    def state(self) -> str:
        if self._state is None:
            self._state = self.version()
        return self._state

    @classmethod
    def forget(cls, spark: SparkSession | None = None) -> None:
        cls.shared.clear()
        if spark is not None:
            drop_folders(spark)

    def version(self) -> str:
        """Number, size and newest time of the files that the shared frames come from."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(
            [f"{self.folder}/{t}.parquet" for t in ("customer", "orders", "lineitem")]).select("path", "length", "modificationTime")
        return str(files.agg(F.count("*"), F.sum("length"), F.max("modificationTime")).first())

    def once(self, name: str, build):
        key = (self.spark.sparkContext.applicationId, id(self.spark._jsparkSession), self.folder, self.state, name)
        if key not in self.shared:
            self.shared[key] = build()
        return self.shared[key]

    def table(self, name: str) -> DataFrame:
        return S.read(self.spark, self.folder, name)

    def facts(self) -> DataFrame:
        return S.raw_facts(self.spark, self.folder)

    def iyf(self) -> DataFrame:
        """One pass over the facts; the result per issuer, year and item is a stored table."""
        return self.once("iyf", lambda: stored(P.issuer_year_facts(self.facts(), FIRST_YEAR, LAST_YEAR), "iyf"))

    def panel(self) -> DataFrame:
        """The panel as a written table.  It is built in the tasks that find the medians, which have all items of an issuer-year
        in order, so that the long table is neither written nor sorted again for it."""
        return self.once("panel", lambda: stored(P.issuer_year_panel(self.facts(), FIRST_YEAR, LAST_YEAR), "panel"))

    def feats(self) -> DataFrame:
        return Fe.engineer(self.panel())

    def stored_feats(self) -> DataFrame:
        """The engineered panel as a written table: every training and scoring query reads it more than once."""
        return self.once("features", lambda: stored(self.feats(), "features"))

    def non_financial(self) -> DataFrame:
        return self.feats().filter(f"financial_flag = '{C.TARGET_SEGMENT}'")

    def model(self) -> Model:
        """The fixed model: literal centroids, exact medians of the non-financial panel."""
        return self.once("model", self._model)

    def _model(self) -> Model:
        use = self.stored_feats().filter(f"financial_flag = '{C.TARGET_SEGMENT}'")
        return Model(
            segment=C.TARGET_SEGMENT, features=list(C.DOMAINS), centroids=CENTROIDS,
            medians=median_row(use, C.DOMAINS),
            labels={c: C.RANK_LABELS[k] for c, k in RANKS.items()}, ranks=dict(RANKS),
        )

    def scored(self) -> DataFrame:
        model = self.model()
        return with_outlook(score_features(self.stored_feats(), model), model)

    def guarded(self) -> DataFrame:
        return apply_guardrails(self.scored())

    def scenarios(self) -> DataFrame:
        return score_scenarios(self.panel(), self.model())

    def clustered(self) -> DataFrame:
        """Eligible rows of the target segment with the clusters of the fixed model, and the
        gap-free model features as x_0 .. x_5."""
        return self.once("clustered", self._clustered)

    def _clustered(self) -> DataFrame:
        model = self.model()
        out = assign_clusters(eligible_rows(self.stored_feats()), model)
        points = [f"coalesce({f}, {num(model.medians[f])}) as x_{i}" for i, f in enumerate(model.features)]
        return stored(out.selectExpr("*", "concat(financial_flag, '__', cluster) as cluster_key", *points), "clustered")


POINTS = [f"x_{i}" for i in range(len(C.DOMAINS))]
