"""The pivot query: measures over any axes, filters, margins, what-if branches and shocks.

``pivot(frames, rows, cols, measures, filters, ...)`` validates names, builds only the blocks the
measures need, and returns one lazy DataFrame. Totals are re-evaluated at their own grain.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.functions.joins import broadcast_if_few
from riskloom.operators import exposure as ex, measures as ms
from riskloom.operators.attribution import forward_pnl
from riskloom.operators.exposure import FAC_DIMS, KEYS, SEC_DIMS

MANAGER_DIMS = ["FirmType", "EntityName", "CIK"]
DIM_NAMES = ["Date", "Book", "Branch", *SEC_DIMS, *FAC_DIMS, "ScenarioSet", "ScenarioDay", *MANAGER_DIMS]


@dataclass(frozen=True)
class Measure:
    """A measure: the blocks it reads and its expression over their columns.

    Blocks: ``spec`` (weights, specific variance), ``ladder`` (own P&L distribution), ``grad`` (linear
    contributions), ``inc`` (book without cell), ``fvol`` (factor vols), ``name`` (position shares),
    ``pnl`` (forward realized P&L), ``mgr`` (manager attributes), ``day`` (one row per scenario day).
    """

    expr: Callable[[], Column]
    needs: frozenset[str] = frozenset()
    scenario: bool = False
    cells: bool = True  # whether it may read a cell's net exposure ``x`` or count ``n``


MEASURES: dict[str, Measure] = {}


def register_measure(name: str, fn: Callable[[], Column], needs: set[str] | frozenset = frozenset(),
                     scenario: bool | None = None, cells: bool = True) -> None:
    """Add a measure under ``name``; ``fn`` returns its Column over the block columns."""
    needs = frozenset(needs)
    scen = bool(needs & {"ladder", "grad", "inc", "fvol", "name", "day"}) if scenario is None else scenario
    MEASURES[name] = Measure(fn, needs, scen, cells)


def _c(n: str) -> Column:
    return F.col(n)


_t_book = lambda: F.sqrt(_c("b_var99") ** 2 + ms.Z99**2 * F.coalesce("S", F.lit(0.0)))
_sig_book = lambda: F.sqrt(_c("b_var") + F.coalesce("S", F.lit(0.0)))
_m_total = lambda: (_c("m_var") * _c("b_var99") + ms.Z99**2 * F.coalesce("svar", F.lit(0.0))) / _t_book()
# book-level sums of the additive marginals: every share divides by these
_tot_total = lambda: (_c("b_read99") * _c("b_var99") + ms.Z99**2 * F.coalesce("S", F.lit(0.0))) / _t_book()
_tot_vol = lambda: (_c("b_var") + F.coalesce("S", F.lit(0.0))) / _sig_book()
_S = lambda: F.coalesce("S", F.lit(0.0))
_s = lambda: F.coalesce("svar", F.lit(0.0))
_null_if0 = lambda c: F.when(c != 0, c)

_READ_X = {"Net exposure", "contributors.COUNT", "VaR sensitivity", "Min-variance hedge ratio", "Vol at min-variance hedge"}

for _n, _f, _need in [
    ("Net exposure", lambda: _c("x"), set()),
    ("contributors.COUNT", lambda: _c("n"), set()),
    ("Net weight", lambda: _c("net_w"), {"spec"}),
    ("Gross weight", lambda: _c("gross_w"), {"spec"}),
    ("Specific variance", lambda: _c("svar"), {"spec"}),
    ("Specific vol", lambda: F.sqrt(_c("svar")), {"spec"}),
    ("Scenario mean PnL", lambda: _c("mean"), {"ladder"}),
    ("Scenario VaR 99", lambda: _c("var99"), {"ladder"}),
    ("Scenario VaR 97.5", lambda: _c("var975"), {"ladder"}),
    ("Scenario VaR 95", lambda: _c("var95"), {"ladder"}),
    ("Scenario worst loss", lambda: _c("worst"), {"ladder"}),
    ("Scenario worst date (epoch)", lambda: F.unix_date("worst_date").cast("long"), {"ladder"}),
    ("Scenario n", lambda: _c("scn_n"), {"ladder"}),
    ("Scenario ES 97.5", lambda: _c("es975"), {"ladder"}),
    ("Scenario ES 99", lambda: _c("es99"), {"ladder"}),
    ("Scenario PnL vol", lambda: _c("vol"), {"vol"}),
    ("Exceedance rate 2s", lambda: _c("exceed"), {"ladder", "exceed"}),
    ("Scenario PnL sorted", lambda: _c("sorted_pnl"), {"sorted"}),
    ("Model vol", lambda: F.sqrt(_c("vol") ** 2 + _s()), {"vol", "spec"}),
    ("Total VaR 99", lambda: F.sqrt(_c("var99") ** 2 + ms.Z99**2 * _s()), {"ladder", "spec"}),
    ("Total ES 97.5", lambda: F.sqrt(_c("es975") ** 2 + ms.Z_ES975**2 * _s()), {"ladder", "spec"}),
    ("Marginal Scenario VaR 99", lambda: _c("m_var"), {"grad"}),
    ("VaR sensitivity", lambda: _c("m_var") / _null_if0(_c("x")), {"grad"}),
    ("% of Scenario VaR 99", lambda: _c("m_var") / _null_if0(_c("b_read99")), {"grad"}),
    ("Marginal Scenario ES 97.5", lambda: _c("m_es"), {"grad"}),
    ("% of Scenario ES 97.5", lambda: _c("m_es") / _null_if0(_c("b_es")), {"grad", "bes"}),
    ("Marginal Total VaR 99", lambda: _m_total(), {"grad", "spec", "book"}),
    ("% of Total VaR 99", lambda: _m_total() / _null_if0(_tot_total()), {"grad", "spec", "book"}),
    ("Factor variance contribution", lambda: _c("m_cov"), {"grad"}),
    ("Marginal Model vol", lambda: (_c("m_cov") + _s()) / _sig_book(), {"grad", "spec", "book"}),
    ("% of Model vol", lambda: (_c("m_cov") + _s()) / _sig_book() / _null_if0(_tot_vol()), {"grad", "spec", "book"}),
    ("Incremental Scenario VaR 99", lambda: _c("bk_read99") - _c("ex_read99"), {"inc"}),
    ("Incremental Total VaR 99",
     lambda: _tot_total() - F.sqrt(_c("ex_read99") ** 2 + ms.Z99**2 * F.greatest(_S() - _s(), F.lit(0.0))),
     {"inc", "grad", "spec", "book"}),
    ("Incremental Model vol",
     lambda: F.sqrt(_c("bk_var") + _S()) - F.sqrt(_c("ex_var") + F.greatest(_S() - _s(), F.lit(0.0))),
     {"inc", "spec", "book"}),
    ("Vol ex factor", lambda: F.sqrt(_c("ex_var") + _S()), {"inc", "spec", "book"}),
    ("Factor return vol", lambda: _c("fvol"), {"fvol"}),
    ("Min-variance hedge ratio", lambda: -_c("m_cov") / _null_if0(_c("x") * _c("fvol") ** 2), {"grad", "fvol"}),
    ("Vol at min-variance hedge",
     lambda: F.sqrt(F.greatest(_c("b_var") - (_c("m_cov") / _null_if0(_c("x") * _c("fvol"))) ** 2, F.lit(0.0)) + _S()),
     {"grad", "fvol", "spec", "book"}),
    ("Stressed model vol",
     lambda: _c("vol_mult") * F.sqrt((1 - _c("rho_blend")) * _c("vol") ** 2 + _c("rho_blend") * _c("sxs") ** 2 + _s()),
     {"vol", "spec", "fvol"}),
    ("Custom stress PnL", lambda: _c("stress_pnl"), {"fvol"}),
    ("Risk HHI", lambda: _c("hhi"), {"name"}),
    ("Top-5 risk share", lambda: _c("top5"), {"name"}),
    ("Factor contribution", lambda: _c("factor_pnl"), {"pnl"}),
    ("Specific PnL", lambda: _c("spec_pnl"), {"pnl"}),
    ("Realized PnL", lambda: _c("factor_pnl") + F.coalesce("spec_pnl", F.lit(0.0)), {"pnl"}),
    ("Manager ETP dropped value share", lambda: _c("dropped_value_share_latest"), {"mgr"}),
    ("Manager n filings", lambda: _c("n_filings"), {"mgr"}),
    ("Manager n positions", lambda: _c("n_positions_distinct"), {"mgr"}),
    ("Scenario PnL at day", lambda: _c("p"), {"day"}),
    ("Scenario date at day (epoch)", lambda: F.unix_date("scen_date").cast("long"), {"day"}),
    ("Scenario VaR line at day", lambda: -_c("d_var99"), {"day"}),
    ("Scenario worst pnl at day", lambda: -_c("d_worst"), {"day"}),
    ("Scenario worst date at day (epoch)", lambda: F.unix_date("d_worst_date").cast("long"), {"day"}),
]:
    register_measure(_n, _f, _need, scenario=bool(
        _need & {"ladder", "vol", "grad", "inc", "fvol", "name", "day", "sorted"}), cells=_n in _READ_X)


class PivotError(ValueError):
    """An invalid pivot specification."""


def validate(rows: list[str], cols: list[str], measures: list[str], filters: Mapping[str, list]) -> None:
    if not rows:
        raise PivotError("select at least one row dimension")
    if not measures:
        raise PivotError("select at least one measure")
    bad = [d for d in [*rows, *cols, *filters] if d not in DIM_NAMES]
    if bad:
        raise PivotError(f"unknown dimension(s): {bad}")
    bad = [m for m in measures if m not in MEASURES]
    if bad:
        raise PivotError(f"unknown measure(s): {bad}")


def _join(left: DataFrame, right: DataFrame | None, on: list[str], how: str = "left") -> DataFrame:
    return left if right is None else left.join(right, on, how)


def check_inputs(frames: Mapping[str, DataFrame], trades: DataFrame | None, shocks: Mapping[str, float] | None) -> None:
    """Refuse trades in names or on (Date, Book) pairs that the model does not have, and shocks on unknown
    factors: they would otherwise change nothing without a word."""
    if trades is not None:
        names = trades.select("Position").distinct().join(frames["exposures"].select("Position"), "Position", "left_anti").limit(5).collect()
        if names:
            raise PivotError(f"trades in unknown positions: {sorted(str(r[0]) for r in names)}")
        books = trades.select("Date", "Book").distinct().join(frames["positions"].select("Date", "Book"), ["Date", "Book"], "left_anti").limit(5).collect()
        if books:
            raise PivotError(f"trades without a book on that date: {sorted((str(r[0]), str(r[1])) for r in books)}")
    if shocks:
        known = {r[0] for r in frames["factor_meta"].filter(F.col("Factor").isin(*shocks)).select("Factor").distinct().collect()}
        if set(shocks) - known:
            raise PivotError(f"shocks on unknown factors: {sorted(set(shocks) - known)}")


def pivot(frames: Mapping[str, DataFrame], rows: list[str], measures: list[str],
          cols: list[str] | None = None, filters: Mapping[str, list] | None = None,
          totals: bool = False, trades: DataFrame | None = None,
          shocks: Mapping[str, float] | None = None, vol_mult: float = 1.0, rho_blend: float = 0.0,
          scenarios: DataFrame | None = None) -> DataFrame:
    """Evaluate ``measures`` over ``rows`` x ``cols``.

    Date and Book must each be on an axis or filtered to one member: a total over books or dates is
    no portfolio. A scenario measure needs ScenarioSet on an axis or filtered to one; otherwise it is
    blank and a warning is given. ``totals`` adds the per-row, per-column and grand margins (column
    ``Margin``), each re-evaluated at its own grain within Date, Book and ScenarioSet.
    ``trades`` runs what-if branches (column ``Branch``), ``shocks`` maps Factor to sigmas.
    """
    cols = list(cols or [])
    filters = {d: list(v) for d, v in (filters or {}).items() if v}
    rows = list(dict.fromkeys(rows))
    cols = [c for c in dict.fromkeys(cols) if c not in rows]
    measures = list(dict.fromkeys(measures))
    validate(rows, cols, measures, filters)
    axes = [*rows, *cols]
    for k in ("Date", "Book"):
        if k not in axes and len(filters.get(k, [])) != 1:
            raise PivotError(f"{k} must be on an axis or filtered to one member")
    if trades is not None and "Date" not in axes and len(filters.get("Date", [])) != 1:
        raise PivotError("a trade set needs a single Date")
    check_inputs(frames, trades, shocks)
    need = frozenset().union(*[MEASURES[m].needs for m in measures])
    wants_set = "ScenarioSet" in axes or any(MEASURES[m].scenario for m in measures)
    one_set = "ScenarioSet" in axes or len(filters.get("ScenarioSet", [])) == 1
    if any(MEASURES[m].scenario for m in measures) and not one_set:
        warnings.warn("scenario measures need one ScenarioSet per cell; they are blank", stacklevel=2)
    if not one_set:
        need = frozenset(n for n in need if n in {"spec", "pnl", "mgr"})
        wants_set = False
    day_axis = "ScenarioDay" in axes or "day" in need
    if day_axis:
        if not wants_set:
            raise PivotError("ScenarioDay needs one ScenarioSet per cell")
        need = need | {"day"}

    # ---- facts -----------------------------------------------------------------------------
    pos = ex.with_branches(frames["positions"], trades)
    sec, fm = frames["securities"], frames["factor_meta"]
    cond = ex.isin_filters({d: v for d, v in filters.items() if d in ("Date", "Book", "Position", "Branch")})
    if cond is not None:
        pos = pos.filter(cond)
    sec_f = {d: v for d, v in filters.items() if d in SEC_DIMS and d != "Position"}
    if sec_f:
        pos = ex.with_security(pos, sec, list(sec_f)).filter(ex.isin_filters(sec_f))
    mgr_f = {d: v for d, v in filters.items() if d in MANAGER_DIMS}
    if mgr_f:
        books = frames["managers"].filter(ex.isin_filters(mgr_f)).select("Book")
        pos = pos.join(F.broadcast(books), "Book", "left_semi")
    expo = frames["exposures"]
    if filters.get("Date"):
        expo = expo.filter(F.col("Date").isin(*filters["Date"]))
    if filters.get("Factor"):
        expo = expo.filter(F.col("Factor").isin(*filters["Factor"]))
    if filters.get("FactorGroup"):
        keep = fm.filter(F.col("FactorGroup").isin(*filters["FactorGroup"])).select("Factor")
        expo = expo.join(F.broadcast(keep), "Factor", "left_semi")

    sec_d = [d for d in axes if d in SEC_DIMS]
    fac_d = [d for d in axes if d in FAC_DIMS]
    dims = sec_d + fac_d
    c_dims = ex.cell_dims(dims)
    cell = [*KEYS, *c_dims]

    leaf = ex.leaf_rows(pos, expo, sec, fm, dims)
    # at the grain of names a sum would keep every row in memory and save none: books, cells and contributions sum for themselves
    fine = "Position" in dims and not totals
    if not fine:
        leaf = ex.leaf_exposure(leaf, dims)
    grains = [("cell", dims)]
    if totals:
        for label, keep in (("per_row", rows), ("per_col", cols), ("grand", [])):
            g = [d for d in dims if d in keep]
            if g not in [q for _, q in grains]:
                grains.append((label, g))
    xs = [ex.roll_up(leaf, dims, g).withColumn("Margin", F.lit(label)) for label, g in grains]
    x = xs[0]
    for more in xs[1:]:
        x = x.unionByName(more)
    cellm = [*cell, "Margin"]
    bx = leaf.groupBy(*KEYS, "Factor").agg(F.sum("x").alias("x"))
    cells = x.groupBy(*cellm).agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    spec = None
    if need & {"spec", "book", "name"}:
        spec_leaf = ex.weight_block(pos, frames["specific_var"], expo, sec, sec_d)
        parts = []
        for label, g in grains:
            if any(d in FAC_DIMS for d in g):
                continue  # specific risk has no factor
            cs = [(F.col(d) if d in g else F.lit(ex.TOTAL)).alias(f"c_{d}") for d in dims]
            parts.append(spec_leaf.select(*KEYS, *cs, "svar", "net_w", "gross_w")
                         .groupBy(*cell).agg(*[F.sum(c).alias(c) for c in ("svar", "net_w", "gross_w")])
                         .withColumn("Margin", F.lit(label)))
        if parts:
            spec = parts[0]
            for more in parts[1:]:
                spec = spec.unionByName(more)

    # tables by book (gradients, totals) meet cells of any grain: counted, so that they are broadcast while few
    books = pos.select(*KEYS).distinct().count() if need & {"grad", "name", "book"} else 0

    # ---- scenarios -------------------------------------------------------------------------
    out = cells
    on = list(cellm)
    if wants_set:
        sh = frames["scenarios"] if scenarios is None else scenarios
        if filters.get("ScenarioSet"):
            sh = sh.filter(F.col("ScenarioSet").isin(*filters["ScenarioSet"]))
        on = [*cellm, "ScenarioSet"]
        lad = vec = None
        if need & {"ladder", "day", "sorted"}:
            vec = ms.pnl_vectors(x, sh, cellm)
            dated = any("worst date" in m for m in measures)
            if need & {"ladder", "vol"}:
                lad = ms.ladder(vec, ms.scenario_dates(sh) if dated else None, "exceed" in need)
        elif "vol" in need:
            # volatility alone is a quadratic form of the factor covariance: no day vectors
            lad = ms.cell_variance(x, sh, cellm).select(
                *on, F.sqrt(F.greatest("cell_var", F.lit(0.0))).alias("vol"))
        bare = "grad" in need and lad is None and "sorted" not in need  # the marginals bring the cells' sets
        if lad is not None:
            out = out.join(lad, cellm)
        elif not bare:
            sets = F.broadcast(sh.select("ScenarioSet", "Factor").distinct())
            fan = x.join(sets, "Factor").select(*on).distinct()
            out = out.join(fan, cellm)
        if "sorted" in need:
            out = out.join(vec.select(*on, F.array_sort("pv").alias("sorted_pnl")), on)
        if need & {"grad", "name"}:
            few = books * sh.select("ScenarioSet", "Factor").distinct().count()
            grads = broadcast_if_few(ms.book_gradients(bx, sh), few)
            if "grad" in need:
                mg = ms.marginals(ex.cell_rows(leaf, dims, dims).withColumn("Margin", F.lit("cell")) if fine else x, grads, cellm)
                out = out.join(mg, cellm if bare else on) if not bare or any(MEASURES[m].cells for m in measures) else mg
            if "bes" in need:
                bes = (bx.join(grads, [*KEYS, "Factor"]).groupBy(*KEYS, "ScenarioSet")
                       .agg(F.sum(F.col("x") * F.col("g_es")).alias("b_es")))
                out = out.join(broadcast_if_few(bes, few), [*KEYS, "ScenarioSet"])
        if "inc" in need:
            out = out.join(ms.incrementals(ms.with_book(x, bx, cellm), sh, cellm), on)
        if "fvol" in need:
            fv = F.broadcast(ms.factor_vol(sh))
            sig = {k: float(v) for k, v in (shocks or {}).items()}
            sigma = F.lit(0.0)
            for f, v in sig.items():
                sigma = F.when(F.col("Factor") == f, F.lit(v)).otherwise(sigma)
            fb = (x.join(fv, "Factor").groupBy(*on).agg(
                F.sum(F.col("x") * F.col("fvol")).alias("sxs"),
                F.sum(F.col("x") * sigma * F.col("fvol")).alias("stress_pnl"),
                F.when(F.count_distinct("Factor") == 1, F.max("fvol")).alias("fvol")))
            out = out.join(fb, on).withColumns({"vol_mult": F.lit(vol_mult), "rho_blend": F.lit(rho_blend)})
        if "name" in need:
            out = out.join(_name_shares(pos, expo, sec, frames["specific_var"], grads, books, sec_d, dims, grains, cell),
                           on, "left")
    if spec is not None:
        out = _join(out, spec, cellm)
    elif need & {"spec", "book", "name"}:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("svar", "net_w", "gross_w")})
    if need & {"book"}:
        tot = (ex.weight_block(pos, frames["specific_var"], expo, sec, [])
               .select(*KEYS, F.col("svar").alias("S")))
        out = out.join(broadcast_if_few(tot, books), KEYS, "left")
    if "pnl" in need:
        out = out.join(_forward_block(frames, pos, expo, dims, grains, cell), cellm, "left")
    if need & {"mgr"} or any(d in MANAGER_DIMS for d in axes):
        out = out.join(F.broadcast(frames["managers"]), "Book", "left")
    if day_axis:
        bk = ms.ladder(ms.pnl_vectors(bx, sh, KEYS)).select(
            *KEYS, "ScenarioSet", F.col("var99").alias("d_var99"), F.col("worst").alias("d_worst"))
        z = vec.join(F.broadcast(ms.scenario_dates(sh)), "ScenarioSet").withColumn(
            "d_worst_date", F.get("dv", (F.array_position("pv", F.array_min("pv")) - 1).cast("int")))
        wd = z.select(*on, "d_worst_date", F.posexplode(F.arrays_zip("pv", "dv")).alias("ScenarioDay", "e"))
        wd = wd.select(*on, "d_worst_date", F.col("ScenarioDay").cast("long").alias("ScenarioDay"),
                       F.col("e.pv").alias("p"), F.col("e.dv").alias("scen_date"))
        out = out.join(wd, on).join(bk, [*KEYS, "ScenarioSet"])

    res = []
    for m in measures:
        blank = MEASURES[m].scenario and not one_set
        res.append((F.lit(None).cast("double") if blank else MEASURES[m].expr()).alias(m))
    keep = [(F.col(f"c_{d}") if d in dims else F.col(d)).alias(d) for d in axes]
    extra = [F.col("Branch")] if trades is not None and "Branch" not in axes else []
    return out.select(*extra, *keep, *([F.col("Margin")] if totals else []), *res)


def _name_shares(pos, expo, sec, sv, grads, books, sec_d, dims, grains, cell):
    """HHI and top-5 share of each cell from position-grain marginal total VaR."""
    pd_ = list(dict.fromkeys([*sec_d, "Position"]))
    p = ex.with_security(pos, sec, pd_)
    j = p.join(expo.select("Date", "Position", "Factor", "Loading"), ["Date", "Position"])
    g = j.select(*KEYS, *pd_, "Factor", (F.col("Weight") * F.col("Loading")).alias("x")).join(
        grads, [*KEYS, "Factor"])
    m = g.groupBy(*KEYS, *pd_, "ScenarioSet").agg(
        F.sum(F.col("x") * F.col("g_var")).alias("m_var"), F.max("b_var99").alias("b_var99"),
        F.max("b_read99").alias("b_read99"))
    sp = ex.weight_block(pos, sv, expo, sec, ["Position"]).select(*KEYS, "Position", "svar")
    tot = ex.weight_block(pos, sv, expo, sec, []).select(*KEYS, F.col("svar").alias("S"))
    m = m.join(sp, [*KEYS, "Position"], "left").join(broadcast_if_few(tot, books), KEYS, "left")
    m = m.withColumn("share", _m_total() / _null_if0(_tot_total()))
    outs = []
    for label, gr in grains:
        if any(d in FAC_DIMS for d in gr):
            continue
        cs = [(F.col(d) if d in gr else F.lit(ex.TOTAL)).alias(f"c_{d}") for d in dims]
        c = m.select(*KEYS, *cs, "ScenarioSet", F.col("Position").alias("_pos"), "share")
        hhi = c.groupBy(*cell, "ScenarioSet").agg(F.sum(F.col("share") ** 2).alias("hhi"))
        w = Window.partitionBy(*cell, "ScenarioSet").orderBy(F.col("share").desc())
        top = (c.withColumn("_r", F.rank().over(w)).filter(F.col("_r") <= 5)
               .groupBy(*cell, "ScenarioSet").agg(F.sum("share").alias("top5")))
        outs.append(hhi.join(top, [*cell, "ScenarioSet"]).withColumn("Margin", F.lit(label)))
    if not outs:
        return m.select(*KEYS).limit(0).select(
            *KEYS, *[F.lit("").alias(f"c_{d}") for d in dims], F.lit("").alias("ScenarioSet"),
            F.lit(0.0).alias("hhi"), F.lit(0.0).alias("top5"), F.lit("").alias("Margin"))
    r = outs[0]
    for o in outs[1:]:
        r = r.unionByName(o)
    return r


def _forward_block(frames, pos, expo, dims, grains, cell):
    fac, spec = forward_pnl(frames, pos, expo, dims)
    outs = []
    for label, g in grains:
        cs = [(F.col(d) if d in g else F.lit(ex.TOTAL)).alias(f"c_{d}") for d in dims]
        f = fac.select(*KEYS, *cs, "factor_pnl").groupBy(*cell).agg(F.sum("factor_pnl").alias("factor_pnl"))
        if not any(d in FAC_DIMS for d in g):
            cs2 = [(F.col(d) if d in g else F.lit(ex.TOTAL)).alias(f"c_{d}") for d in dims]
            s = spec.select(*KEYS, *cs2, "spec_pnl").groupBy(*cell).agg(F.sum("spec_pnl").alias("spec_pnl"))
            f = f.join(s, cell, "full_outer")
        else:
            f = f.withColumn("spec_pnl", F.lit(None).cast("double"))
        outs.append(f.withColumn("Margin", F.lit(label)))
    r = outs[0]
    for o in outs[1:]:
        r = r.unionByName(o)
    return r
