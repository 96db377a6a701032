"""Frame-level queries: the model frames themselves."""

from riskloom.catalog.oracle import sql
from riskloom.catalog.registry import query, tidy_sql
from riskloom.sources import tables


@query("frame_positions", sql(tidy_sql("SELECT * FROM pos", "weight", 9), "pos"), 9)
def _(spark, sf):
    return tables.frames(spark, sf).positions


@query("frame_exposures", sql(tidy_sql("SELECT * FROM expo", "loading"), "expo"))
def _(spark, sf):
    return tables.frames(spark, sf).exposures


@query("frame_specific_var", sql(tidy_sql("SELECT date, position, sv AS specificvar FROM sv", "specificvar", 9), "sv"), 9)
def _(spark, sf):
    return tables.frames(spark, sf).specific_var


@query("frame_specific_returns", sql(tidy_sql("SELECT date, position, sret AS specificreturn FROM sr", "specificreturn", 12), "sr"), 12)
def _(spark, sf):
    return tables.frames(spark, sf).specific_returns


@query("vec01_scenario_sets", sql(tidy_sql(
    "SELECT scenarioset, CAST(day_idx AS BIGINT) AS day_idx, scen_date, factor, shock FROM scn", "shock"), "scn"))
def _(spark, sf):
    return tables.frames(spark, sf).scenarios
