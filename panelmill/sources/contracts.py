"""Column contracts of the panel tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Col:
    name: str
    kind: str
    nullable: bool = False
    required: bool = True
    lo: float | None = None
    hi: float | None = None
    allowed: tuple | None = None


@dataclass(frozen=True)
class Contract:
    code: str
    columns: tuple[Col, ...]
    keys: tuple[str, ...] = ("date", "permno")
    prefixes: dict[str, tuple[str, int]] = field(default_factory=dict)  # prefix -> (kind, least number of columns)
    prefix_bound: dict[str, float] = field(default_factory=dict)
    complete_when: tuple[str, tuple[str, ...]] | None = None  # flag, columns that must be present when it is true


KINDS: dict[str, tuple[type, ...]] = {
    "date": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType, T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "bool": (T.BooleanType,),
    "str": (T.StringType,),
}

_KEY = (Col("date", "date"), Col("permno", "int"))


def _floats(names: str, **kw) -> tuple[Col, ...]:
    return tuple(Col(n, "float", **kw) for n in names.split())


# Column names, bounds and key sets of the exchanged tables.
CONTRACTS: dict[str, Contract] = {
    "universe": Contract(
        "C1",
        (
            *_KEY, Col("in_universe", "bool"), *_floats("me price", nullable=True, lo=0.0), Col("exchcd", "int", nullable=True),
            Col("ff49", "int", allowed=tuple(range(50))), Col("nyse_size_pct", "float", nullable=True, lo=0.0, hi=100.0),
        ),
        complete_when=("in_universe", ("me", "price", "exchcd", "nyse_size_pct")),
    ),
    "signals": Contract("C2", _KEY, prefixes={"sig_": ("float", 10), "miss_": ("int", 0)}, prefix_bound={"sig_": 0.5}),
    "signal_meta": Contract("C3", (Col("signal", "str"), Col("theme", "str"), Col("pub_year", "int"), Col("source", "str")), keys=("signal",)),
    "targets": Contract(
        "C4", (*_KEY, *_floats("r_1m r_3m r_6m r_12m ret_next", nullable=True), Col("div_next", "float", nullable=True, required=False, lo=0.0))
    ),
    "states": Contract(
        "C5", (Col("date", "date"), *_floats("MKTVOL BEAR ILLIQ SENT CREDIT TERM INFL DRATE DISP")), keys=("date",), prefixes={"FMOM_": ("float", 0)}
    ),
    "cost_inputs": Contract("C6", (*_KEY, *_floats("spread sigma_d adv_usd borrow_fee", lo=0.0))),
    "predictions": Contract("C9", (*_KEY, *_floats("score alpha"), Col("unc_sd", "float", nullable=True, lo=0.0))),
    "weight_proposals": Contract("C10", (*_KEY, Col("w_prop", "float"))),
    "weights": Contract("C11", (*_KEY, Col("w", "float"))),
    "returns": Contract(
        "C12",
        (
            Col("date", "date"), *_floats("gross_ret net_ret turnover cost_spread cost_impact cost_borrow long_ret short_ret"),
            *_floats("after_tax_ret tax_ret realised_st realised_lt wash_disallowed", nullable=True, required=False),
        ),
        keys=("date",),
    ),
    "trials": Contract(
        "C13",
        (
            *(Col(n, "str") for n in ("run_id", "strategy", "cell", "params_json")), Col("seed", "int"), Col("train_end", "str"),
            Col("val_metric", "float", nullable=True), Col("git_sha", "str"), Col("timestamp", "str"),
        ),
        keys=(),
    ),
}
