"""The frame contract: column types and keys of every frame the query half reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_D, _S, _F, _L, _I = T.DateType(), T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _st(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


SCHEMAS: dict[str, T.StructType] = {
    "exposures": _st(Date=_D, Position=_S, Factor=_S, Loading=_F),
    "positions": _st(Date=_D, Book=_S, Position=_S, Weight=_F, MV=_F, ADV=_F),
    "securities": _st(Position=_S, Ticker=_S, CIK=_L, CUSIP=_S, Issuer=_S, Sector=_S, Country=_S),
    "factor_meta": _st(Factor=_S, FactorGroup=_S),
    "factor_returns": _st(Date=_D, Factor=_S, Return=_F),
    "specific_var": _st(Date=_D, Position=_S, SpecificVar=_F),
    "specific_returns": _st(Date=_D, Position=_S, SpecificReturn=_F),
    "managers": _st(Book=_S, CIK=_S, EntityName=_S, FirmType=_S, first_filing_date=_D,
                    last_filing_date=_D, n_filings=_L, n_distinct_cusips_parsed=_L,
                    dropped_value_share_latest=_F, n_positions_distinct=_L),
    "prices": _st(Position=_S, Date=_D, Close=_F, Volume=_F),
    "scenarios": _st(ScenarioSet=_S, day_idx=_I, scen_date=_D, Factor=_S, shock=_F),
}

KEYS: dict[str, list[str]] = {
    "exposures": ["Date", "Position", "Factor"],
    "positions": ["Date", "Book", "Position"],
    "securities": ["Position"],
    "factor_meta": ["Factor"],
    "factor_returns": ["Date", "Factor"],
    "specific_var": ["Date", "Position"],
    "specific_returns": ["Date", "Position"],
    "managers": ["Book"],
    "prices": ["Position", "Date"],
    "scenarios": ["ScenarioSet", "day_idx", "Factor"],
}

REQUIRED = ["exposures", "positions", "securities", "factor_meta", "factor_returns", "specific_var"]
OPTIONAL = ["specific_returns", "managers"]
DERIVED = ["prices", "scenarios"]


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project and cast ``df`` to the contract of frame ``name``; fail on a missing column."""
    want = SCHEMAS[name]
    missing = [f.name for f in want if f.name not in df.columns]
    if missing:
        raise ValueError(f"frame {name!r} lacks columns {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want])


def duplicate_keys(df: DataFrame, name: str) -> DataFrame:
    """Rows of the key that occur more than once (empty when the frame honours its key)."""
    return df.groupBy(*KEYS[name]).count().filter("count > 1")
