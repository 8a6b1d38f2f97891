"""A small semantic layer: named facts and dimensions over one DataFrame.

``semantic_query`` validates the requested names (synonyms resolve first,
case-insensitively; an ambiguous synonym is an error) and compiles to a plain
``select``/``where`` (row level) or ``groupBy``/``agg`` (with aggregates). The
result is an ordinary DataFrame, so Catalyst prunes unused columns and pushes the
filters into the scan.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_AGGS = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count,
}


@dataclass
class SemanticModel:
    name: str
    table: DataFrame
    primary_key: list[str]
    facts: dict[str, str]            # semantic name -> column of ``table``
    dimensions: dict[str, str]       # semantic name -> column of ``table``
    synonyms: dict[str, str] = field(default_factory=dict)   # business term -> semantic name
    table_synonyms: list[str] = field(default_factory=list)
    comments: dict[str, str] = field(default_factory=dict)

    def resolve(self, term: str) -> str:
        """Map a name or synonym to a semantic name."""
        t = term.strip().lower()
        names = {n.lower(): n for n in [*self.facts, *self.dimensions]}
        if t in names:
            return names[t]
        hits = {target for syn, target in self.synonyms.items() if syn.lower() == t}
        if len(hits) > 1:
            raise ValueError(f"ambiguous synonym {term!r}: {sorted(hits)}")
        if not hits:
            raise KeyError(f"{term!r} is not a fact, dimension or synonym of {self.name}")
        return hits.pop()

    def column(self, name: str) -> Column:
        sem = self.resolve(name)
        src = self.facts.get(sem) or self.dimensions[sem]
        return F.col(src).alias(sem)


def semantic_query(model: SemanticModel, dimensions: list[str], facts: list[str] | None = None,
                   aggregates: dict[str, str] | None = None,
                   filters: list[Column] | None = None) -> DataFrame:
    """Compile a semantic request.

    ``facts`` returns row-level facts; ``aggregates`` maps an output alias to
    ``"<fn>(<fact>)"`` (``fn`` one of sum/avg/min/max/count) and groups by the
    dimensions. ``filters`` are Column predicates over the model's own columns.
    """
    df = model.table
    for f in filters or []:
        df = df.where(f)
    dims = [model.column(d) for d in dimensions]
    for d in dimensions:
        if model.resolve(d) not in model.dimensions:
            raise ValueError(f"{d!r} is not a dimension")
    if not aggregates:
        cols = dims + [model.column(f) for f in facts or []]
        for f in facts or []:
            if model.resolve(f) not in model.facts:
                raise ValueError(f"{f!r} is not a fact")
        return df.select(*cols)
    aggs = []
    for alias, spec in aggregates.items():
        fn, _, arg = spec.partition("(")
        arg = arg.rstrip(")").strip()
        if fn not in _AGGS:
            raise ValueError(f"unknown aggregate {fn!r}")
        if arg == "*":
            aggs.append(F.count(F.lit(1)).alias(alias))
            continue
        sem = model.resolve(arg)
        if sem not in model.facts:
            raise ValueError(f"{arg!r} is not a fact")
        aggs.append(_AGGS[fn](F.col(model.facts[sem])).alias(alias))
    return df.groupBy(*dims).agg(*aggs)


# -- the reference's cost-sharing model -------------------------------------------

PLAN_SCHEMA = T.StructType([
    T.StructField("plan_code", T.StringType(), False),
    T.StructField("plan_name", T.StringType(), False),
    T.StructField("service_type", T.StringType(), False),
    T.StructField("copay_usd", T.DecimalType(10, 2), True),
    T.StructField("coinsurance_pct", T.DecimalType(5, 2), True),
    T.StructField("deductible_applies", T.BooleanType(), True),
    T.StructField("effective_date", T.DateType(), True),
])

# The seven plan / service rows of the reference's gold script
# (plan_code, plan_name, service_type, copay_usd, coinsurance_pct, deductible_applies).
PLAN_ROWS = [
    ("PPO", "PPO Plan", "primary_care", "25.00", None, False),
    ("PPO", "PPO Plan", "specialist", "50.00", None, False),
    ("PPO", "PPO Plan", "urgent_care", "75.00", None, False),
    ("PPO", "PPO Plan", "emergency_room", "250.00", None, False),
    ("PPO", "PPO Plan", "telehealth_primary", "15.00", None, False),
    ("HMO", "HMO Plan", "primary_care", "25.00", None, False),
    ("HMO", "HMO Plan", "specialist", "50.00", None, True),
]


def plan_cost_sharing(spark: SparkSession, effective: date) -> DataFrame:
    """gold.plan_cost_sharing: literal rows, effective date injected."""
    from decimal import Decimal
    rows = [(a, b, c, Decimal(d), e, f, effective) for a, b, c, d, e, f in PLAN_ROWS]
    return spark.createDataFrame(rows, PLAN_SCHEMA)


def member_cost_sharing_model(plans: DataFrame) -> SemanticModel:
    return SemanticModel(
        name="member_cost_sharing",
        table=plans,
        primary_key=["plan_code", "service_type"],
        facts={"copay_usd": "copay_usd", "coinsurance_pct": "coinsurance_pct"},
        dimensions={"plan_code": "plan_code", "plan_name": "plan_name",
                    "service_type": "service_type", "deductible_applies": "deductible_applies"},
        synonyms={"visit type": "service_type", "care setting": "service_type"},
        table_synonyms=["cost sharing", "copays", "member cost"],
    )


def member_copay_view(plans: DataFrame, as_of: date) -> DataFrame:
    """The relational view: fixed columns, rows effective on or before ``as_of``."""
    return plans.where(F.col("effective_date") <= F.lit(as_of)).select(
        "plan_code", "plan_name", "service_type", "copay_usd", "coinsurance_pct",
        "deductible_applies")


def orders_model(orders: DataFrame, customer: DataFrame) -> SemanticModel:
    """The same operator over driver tables: orders with their customer segment."""
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return SemanticModel(
        name="orders",
        table=joined,
        primary_key=["o_orderkey"],
        facts={"total_price": "o_totalprice"},
        dimensions={"market_segment": "c_mktsegment", "order_priority": "o_orderpriority",
                    "order_status": "o_orderstatus"},
        synonyms={"segment": "market_segment", "priority": "order_priority",
                  "status": "order_status"},
    )
