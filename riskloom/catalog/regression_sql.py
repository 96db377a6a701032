"""SQL twins of the cross-sectional regressions: the design, its normal equations, and their least-norm solution.

A normal system is reduced column by column, one CTE each. A column that depends on earlier ones has no pivot: its row
is dropped, and what is left in the column says how it depends. The basic solution, less its part along every such
direction, is the least-norm solution of a pseudo-inverse.
"""

from __future__ import annotations

from riskloom.catalog.oracle import sql
from riskloom.catalog.q_attr import AT
from riskloom.catalog.registry import tidy_sql
from riskloom.sources.tables import STYLES

#: columns of the design: the market, the styles but one (the shares of a name add up to one), four countries against the heaviest
FIT = [s for s in sorted(STYLES) if s != "STANDARD"]
SLOTS = 4
K = 1 + len(FIT) + SLOTS
X = ["1.0::DOUBLE", *[f"s_{f}" for f in FIT], *[f"g_{j}" for j in range(1, SLOTS + 1)]]
R = range(K)
Ctes = dict[str, tuple[tuple[str, ...], str]]


def least_norm(base: str, key: str, prefix: str, solve: bool = True) -> tuple[str, Ctes]:
    """(last CTE, all CTEs) for ``base`` with ``key``, m_i_j (i <= j) and c_i: ok_p (column p has a pivot), the generalised
    inverse e_i_j, and with ``solve`` the least-norm solution x_i."""
    cells = [f"m_{min(i, j)}_{max(i, j)} AS a_{i}_{j}" for i in R for j in R]
    unit = [f"{float(i == j)}::DOUBLE AS e_{i}_{j}" for i in R for j in R]
    diag = [f"m_{i}_{i} AS d_{i}" for i in R]
    ctes: Ctes = {f"{prefix}_0": ((base,), f"SELECT {key}, {', '.join([*cells, *unit, *diag])} FROM {base}")}
    for p in R:
        ok = f"(a_{p}_{p} > 1e-9 * greatest(d_{p}, 1e-300))"
        cols = [f"{ok} AS ok_{p}"]
        for m in "ae":
            for i in R:
                for j in R:
                    pivot = f"{m}_{p}_{j} / a_{p}_{p}"
                    new, old = (pivot, "0.0::DOUBLE") if i == p else (f"{m}_{i}_{j} - a_{i}_{p} * {pivot}", f"{m}_{i}_{j}")
                    cols.append(f"CASE WHEN {ok} THEN {new} ELSE {old} END AS {m}_{i}_{j}")
        keep = [*[f"d_{i}" for i in R], *[f"ok_{q}" for q in range(p)]]
        ctes[f"{prefix}_{p + 1}"] = ((f"{prefix}_{p}",), f"SELECT {key}, {', '.join([*keep, *cols])} FROM {prefix}_{p}")
    last = f"{prefix}_{K}"
    if not solve:
        return last, ctes
    basic = [f"CASE WHEN ok_{i} THEN {' + '.join(f'e_{i}_{j} * c_{j}' for j in R)} ELSE 0 END AS x_{i}" for i in R]
    # directions without an effect, made orthogonal one after the other; the solution loses its part along each
    ways = [f"CASE WHEN ok_{r} THEN 0.0::DOUBLE WHEN ok_{i} THEN -a_{i}_{r} ELSE {float(i == r)}::DOUBLE END AS z_{i}_{r}" for i in R for r in R]
    ctes[f"{prefix}_x0"] = ((base, last), f"SELECT g.*, {', '.join([*basic, *ways])} FROM {last} g JOIN {base} USING ({key})")
    for p in R:
        norm = " + ".join(f"z_{i}_{p} * z_{i}_{p}" for i in R)
        shares = [f"CASE WHEN ok_{p} THEN 0.0 ELSE ({' + '.join(f'{v.format(i)} * z_{i}_{p}' for i in R)}) / ({norm}) END AS f_{n}"
                  for n, v in [("x", "x_{}"), *[(r, "z_{}_" + str(r)) for r in R if r > p]]]
        new = [f"x_{i} - f_x * z_{i}_{p} AS x_{i}" for i in R] + [f"z_{i}_{r} - f_{r} * z_{i}_{p} AS z_{i}_{r}" for i in R for r in R if r > p]
        ctes[f"{prefix}_f{p}"] = ((f"{prefix}_x{p}",), f"SELECT *, {', '.join(shares)} FROM {prefix}_x{p}")
        drop = ", ".join(f"f_{n}" for n in ["x", *[r for r in R if r > p]])
        ctes[f"{prefix}_x{p + 1}"] = ((f"{prefix}_f{p}",), f"SELECT * EXCLUDE ({drop}) REPLACE ({', '.join(new)}) FROM {prefix}_f{p}")
    return f"{prefix}_x{K}", ctes


def _cross(key: str, y: str) -> str:
    cols = [f"sum(w2 * {X[i]} * {X[j]}) AS m_{i}_{j}" for i in R for j in R if i <= j] + [f"sum(w2 * {X[i]} * {y}) AS c_{i}" for i in R]
    return f"{key}, count(*) AS n, sum(w2) AS sw, sum(w2 * {y}) AS sy, sum(w2 * {y} * {y}) AS yy, {', '.join(cols)}"


_styles = ", ".join(f"max(loading) FILTER (WHERE factor = '{f}') AS v_{f}" for f in FIT)
_moment = ", ".join(f"(sum(v_{f} * v_{f}) - pow(sum(v_{f}), 2) / count(*)) / nullif(count(*) - 1, 0) AS q_{f}" for f in FIT)
_names = ["Market", *FIT]
DAY, _day = least_norm("rgd", "date", "rd")
MON, _mon = least_norm("rgm", "d0", "rm", solve=False)
_full = " AND ".join([f"(ok_{i} OR NOT has_{i})" for i in R])
_name = [f"'{n}'" for n in _names] + [f"'Ind:' || h{j}" for j in range(1, SLOTS + 1)]

CTES: Ctes = {
    **AT, **_day, **_mon,
    "rk": (("expo",), "SELECT count(DISTINCT factor) AS k FROM expo WHERE factor NOT IN ('Market', 'STANDARD')"),
    "rn": (("expo", "sec", "rk"), f"""SELECT * FROM (SELECT e.*, s.country, exp(coalesce(v_LARGE, 0) / 2) AS w2 FROM (SELECT date AS d0, position, count(*) AS c, {_styles}
        FROM expo WHERE factor NOT IN ('Market', 'STANDARD') GROUP BY ALL) e LEFT JOIN sec s USING (position)), rk WHERE c >= k // 2 + 1"""),
    "rv": (("rn",), f"SELECT d0, count(*) AS n_e, {_moment} FROM rn GROUP BY d0 HAVING count(*) >= 8"),
    "rc": (("rn",), "SELECT d0, country, sum(w2) AS c FROM rn WHERE country IS NOT NULL AND country <> 'Unknown' GROUP BY ALL"),
    "rr0": (("rc",), "SELECT d0, country AS ref, c AS rc, row_number() OVER (PARTITION BY d0 ORDER BY c DESC, country DESC) AS r, count(*) OVER (PARTITION BY d0) AS k FROM rc"),
    "ro": (("rc", "rr0"), """SELECT rc.d0, rc.country, rc.c / rr0.rc AS ratio, row_number() OVER (PARTITION BY rc.d0 ORDER BY rc.country) AS slot
        FROM rc JOIN rr0 ON rr0.d0 = rc.d0 AND rr0.r = 1 AND rr0.k >= 2 WHERE rc.country <> rr0.ref"""),
    "rg": (("rv", "rr0", "ro"), f"""SELECT rv.*, ref, {', '.join(f"h{j}, r{j}" for j in range(1, SLOTS + 1))} FROM rv LEFT JOIN (SELECT d0, ref FROM rr0 WHERE r = 1 AND k >= 2) USING (d0)
        LEFT JOIN (SELECT d0, {', '.join(f"max(country) FILTER (WHERE slot = {j}) AS h{j}, max(ratio) FILTER (WHERE slot = {j}) AS r{j}" for j in range(1, SLOTS + 1))} FROM ro GROUP BY d0) USING (d0)
        WHERE q_LARGE > 0.0025"""),
    "rx": (("rn", "rg"), f"""SELECT n.d0, n.position, n.w2, {', '.join(f"CASE WHEN q_{f} > 0.0025 THEN coalesce(v_{f}, 0) ELSE 0 END AS s_{f}" for f in FIT)},
        {', '.join(f"CASE WHEN h{j} IS NULL THEN 0.0 WHEN n.country = h{j} THEN 1.0 WHEN n.country = ref THEN -r{j} ELSE 0.0 END AS g_{j}" for j in range(1, SLOTS + 1))} FROM rn n JOIN rg USING (d0)"""),
    "rh": (("rg",), f"""SELECT d0, ref, {', '.join(f"h{j}, r{j}" for j in range(1, SLOTS + 1))}, true AS has_0, {', '.join(f"coalesce(q_{f} > 0.0025, false) AS has_{i}" for i, f in enumerate(FIT, 1))},
        {', '.join(f"h{j} IS NOT NULL AS has_{len(FIT) + j}" for j in range(1, SLOTS + 1))} FROM rg"""),
    # days: names with a return under the design of the month-end before
    "ry": (("sr", "fr", "days", "rx"), """SELECT s.date, d.d0, x.* EXCLUDE (d0), s.sret + m.ret AS y FROM sr s JOIN fr m ON m.date = s.date AND m.factor = 'Market'
        JOIN (SELECT day, max(e) AS d0 FROM (SELECT DISTINCT date AS day FROM sr) JOIN (SELECT DISTINCT d0 AS e FROM rx) ON e < day GROUP BY day) d ON d.day = s.date
        JOIN rx x ON x.d0 = d.d0 AND x.position = s.position"""),
    "rgd": (("ry",), f"SELECT {_cross('date, any_value(d0) AS d0', 'y')} FROM ry GROUP BY date HAVING count(*) >= 12"),
    "rs": ((DAY, "rgd", "rh"), f"""SELECT g.*, b.d0, b.n, b.yy - ({' + '.join(f'x_{i} * c_{i}' for i in R)}) AS ss, b.yy - b.sy * b.sy / b.sw AS st, h.* EXCLUDE (d0),
        {' + '.join(f'has_{i}::INT' for i in R)} AS k, {_full} AS fullrank FROM {DAY} g JOIN rgd b USING (date) JOIN rh h USING (d0)"""),
    "rf": (("rs",), " UNION ALL ".join(
        f"SELECT date, {_name[i]} AS factor, x_{i} AS ret, CASE WHEN fullrank AND n > k AND e_{i}_{i} * ss > 0 THEN x_{i} / sqrt(e_{i}_{i} * greatest(ss, 0) / (n - k)) END AS tstat, 1 - greatest(ss, 0) / st AS r2, n FROM rs WHERE has_{i}"
        for i in R) + f" UNION ALL SELECT date, 'Ind:' || ref, -({' + '.join(f'coalesce(r{j}, 0) * x_{len(FIT) + j}' for j in range(1, SLOTS + 1))}), NULL, 1 - greatest(ss, 0) / st, n FROM rs WHERE ref IS NOT NULL"),
    # months: pure factor portfolios
    "rgm": (("rx",), f"SELECT {_cross('d0', '0.0')} FROM rx GROUP BY d0"),
    "rp": ((MON, "rx", "rh"), " UNION ALL ".join(
        f"SELECT x.d0, {_name[i]} AS factor, position, w2 * ({' + '.join(f'e_{i}_{j} * {X[j]}' for j in R)}) AS weight, {', '.join(f'{X[j]} AS z_{j}' for j in R)} FROM rx x JOIN {MON} USING (d0) JOIN rh USING (d0) WHERE has_{i}" for i in R)),
    "rq": (("rp", "rh"), " UNION ALL ".join(
        f"SELECT d0, p.factor, {_name[j]} AS t, sum(weight * z_{j}) AS x FROM rp p JOIN rh USING (d0) WHERE has_{j} GROUP BY ALL" for j in R)),
}


def reg(body: str, doubles: str, *need: str, digits: int = 6) -> str:
    local: Ctes = {}

    def add(n: str) -> None:
        if n in CTES and n not in local:
            for dep in CTES[n][0]:
                add(dep)
            local[n] = CTES[n]

    for n in need:
        add(n)
    return sql(tidy_sql(body, doubles, digits), **local)


RETURNS = reg('SELECT date, factor, ret AS "return" FROM rf', "return", "rf")
STATISTICS = reg("SELECT date, factor, tstat, r2, CAST(n AS BIGINT) AS n FROM rf", "tstat r2", "rf")
HEALTH = reg("""SELECT month, avg(r2) AS mean_r2, min(n) AS n_min, median(n) AS n_median, max(n) AS n_max FROM (SELECT last_day(date) AS month, date, any_value(r2) AS r2, any_value(n) AS n FROM rf GROUP BY date) GROUP BY month""",
             "mean_r2 n_median", "rf")
SIGNIFICANCE = reg("SELECT factor, avg(CASE WHEN abs(tstat) > 2 THEN 1.0::DOUBLE ELSE 0 END) AS share_significant, avg(abs(tstat)) AS mean_abs_t, count(*) AS days FROM rf WHERE tstat IS NOT NULL GROUP BY factor",
                   "share_significant mean_abs_t", "rf")
PORTFOLIOS = reg("SELECT d0, factor, position, weight FROM rp", "weight", "rp")
PURITY = reg("""SELECT d0, factor, n_names, gross_leverage, net, self_exposure, max_cross_exposure FROM (SELECT d0, factor, count(*) AS n_names, sum(abs(weight)) AS gross_leverage, sum(weight) AS net FROM rp GROUP BY ALL)
    JOIN (SELECT d0, factor, max(CASE WHEN t = factor THEN x END) AS self_exposure, max(CASE WHEN t <> factor THEN abs(x) END) AS max_cross_exposure FROM rq GROUP BY ALL) USING (d0, factor)""",
             "gross_leverage net self_exposure max_cross_exposure", "rp", "rq")
