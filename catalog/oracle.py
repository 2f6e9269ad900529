"""SQL equivalents of the registered queries, written for DuckDB on the same tables."""

from __future__ import annotations

from rosterlens.operators.evaluate import CANDIDATES
from rosterlens.operators.scoring import LinearScore

from .cohort import (
    CATEGORICAL,
    COHORT_SQL,
    COUNTED,
    NINE,
    NUMERIC,
    RISK_MODELS,
    SCENARIO,
    SCENARIO_BASE,
    SCENARIO_OVERRIDES,
    SCORE_MODEL,
    THRESHOLDS,
)

SQL: dict[str, str] = {}


def oracle(name: str, body: str, *ctes: str) -> None:
    """``body`` selects from ``cohort`` or ``gappy``; extra CTEs go between."""
    SQL[name] = "with " + ",\n".join([COHORT_SQL.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()


def col(c: str) -> str:
    return '"rank"' if c == "rank" else c


def rnd(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) as {name}"


def bin30(c: str) -> str:
    """Bin of a column's value among 30 of equal width; the ends are in the table ``ends``."""
    return f"least(floor(({c}::double - {c}_lo) / ({c}_hi - {c}_lo) * 30), 29)::int"


def union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


def margin(m: LinearScore, inputs: dict[str, str] | None = None) -> str:
    at = lambda c: (inputs or {}).get(c, col(c))
    terms = [f"{coef} * (({at(c)}) - {mean}) / {std}" for c, mean, std, coef in m.numeric]
    terms += [f"case when {at(c)} = '{v}' then {coef} else 0.0 end" for c, v, coef in m.levels]
    return f"({m.intercept} + " + " + ".join(f"({t})" for t in terms) + ")"


def score(m: LinearScore, inputs: dict[str, str] | None = None) -> str:
    x = margin(m, inputs)
    return f"(1.0 / (1.0 + exp(-{x})))" if m.link == "logit" else x


RISKS = ", ".join(f"{score(m)} as {n}" for n, m in RISK_MODELS.items())
SCORED = f"scored as (select *, {RISKS}, {score(SCORE_MODEL)} as score from cohort)"
HASH = "md5('42|' || cast(o_orderkey as varchar))"

# --- cleaning, filters, selection

oracle(
    "clean_cohort",
    """
select o_orderkey, trend as trend_text, mos, round(qty, 6) as qty,
       case when qty >= 100 then 'ready' else 'not_ready' end as size_label,
       case when lower("rank") in ('5-low', '4-not specified') then 1 else 0 end as low_rank
from gappy where qty is not null and mos is not null""",
)
oracle(
    "complete_case_report",
    """
select count(*) as n_rows,
       count(*) filter (where qty is not null and mos is not null and o_totalprice is not null) as n_complete
from gappy""",
)
oracle(
    "filter_equal",
    """
select o_orderkey, brigade_level, "rank", round(o_totalprice, 2) as o_totalprice from cohort
where division_level = 'EUROPE' and mos = 'MACHINERY' and n_lines = 4""",
)
oracle("filter_options", 'select distinct mos as "option" from gappy where mos is not null')
oracle(
    "unit_options",
    "select division_level, brigade_level, count(*) as n from cohort group by division_level, brigade_level",
)
oracle("options_within", "select distinct brigade_level as \"option\" from cohort where division_level = 'ASIA'")
oracle(
    "pick_record",
    f"""
select o_orderkey, brigade_level, mos, round(o_totalprice, 2) as o_totalprice from cohort
order by {HASH}, o_orderkey limit 1""",
)
oracle(
    "pick_record_by_key",
    'select o_orderkey, brigade_level, mos, "rank", n_lines from cohort where o_orderkey = 7',
)

# --- profiles

oracle("table_shape", "select count(*) as n_rows, 13 as n_columns from cohort")
oracle(
    "numeric_profile",
    union(
        [
            f"""select '{c}' as "column", count({c}) as count, {rnd(f"avg({c})", "mean", 4)},
    {rnd(f"stddev_samp({c})", "std", 4)}, {rnd(f"min({c})::double", "min", 4)},
    {rnd(f"quantile_cont({c}::double, 0.25)", "q25", 4)}, {rnd(f"quantile_cont({c}::double, 0.5)", "q50", 4)},
    {rnd(f"quantile_cont({c}::double, 0.75)", "q75", 4)}, {rnd(f"max({c})::double", "max", 4)} from gappy"""
            for c in COUNTED
        ]
    ),
)


def _counts(cols: list[str], table: str = "gappy") -> str:
    return union(
        [
            f"select '{c}' as \"column\", cast({col(c)} as varchar) as value, count(*) as n "
            f"from {table} where {col(c)} is not null group by 2"
            for c in cols
        ]
    )


oracle(
    "text_profile",
    """
select "column", cast(sum(n) as bigint) as count, count(*) as "unique",
       first(value order by n desc, value) as top, max(n) as freq
from counts group by "column" """,
    f"counts as ({_counts([*CATEGORICAL, 'brigade_level'])})",
)
ALL_COLUMNS = [
    "o_orderkey",
    "division_level",
    "brigade_level",
    "mos",
    "rank",
    "trend",
    "o_totalprice",
    "c_acctbal",
    "qty",
    "disc",
    "n_lines",
    "returned",
    "low_flag",
]
oracle(
    "missing_rates",
    "select * from rates order by missing_rate desc, 1 limit 20",
    "rates as ("
    + union(
        [
            f"select '{c}' as \"column\", {rnd(f'avg(case when {col(c)} is null then 1 else 0 end)', 'missing_rate')} from gappy"
            for c in ALL_COLUMNS
        ]
    )
    + ")",
)
oracle(
    "null_report",
    union(
        [
            f"select '{c}' as \"column\", {i} as position, '{t}' as dtype, count({c}) as non_null from gappy"
            for i, (c, t) in enumerate(
                [("mos", "string"), ("qty", "double"), ("n_lines", "bigint"), ("returned", "int")]
            )
        ]
    ),
)
oracle(
    "kpi_rates",
    "select "
    + ", ".join(rnd(f"avg({c}) * 100", c, 4) for c in ("o_totalprice", "disc", "returned", "low_flag"))
    + " from cohort",
)
for key, group, flag, table in (
    ("observed_rate_by_unit", "brigade_level", "low_flag", "cohort"),
    ("observed_rate_by_mos", "mos", "returned", "gappy"),
):
    oracle(
        key,
        f"""
select {group}, n, round(rate, 6) as rate, round(rate * 100, 6) as percent from (
  select {group}, count(*) as n, avg({flag}) as rate from {table} where {group} is not null group by {group})
order by rate desc, {group} limit 20""",
    )
oracle("category_counts", _counts([*CATEGORICAL, "returned"]))
oracle(
    "class_share",
    """
select low_flag, count(*) as n, round(count(*) / (select count(*) from cohort), 6) as proportion
from cohort group by low_flag""",
)
oracle(
    "group_summary",
    f"""
select trend, count(qty) as n, {rnd("avg(qty)", "mean")}, {rnd("stddev_samp(qty)", "std")},
       {rnd("var_samp(qty)", "var")} from gappy where qty is not null group by trend""",
)
oracle(
    "column_quantile",
    union(
        [
            f"select '{c}' as \"column\", cast({p} as double) as prob, {rnd(f'quantile_cont({c}, {p})', 'quantile', 4)} from gappy"
            for c in ("qty", "o_totalprice")
            for p in (0.05, 0.25, 0.333, 0.9)
        ]
    ),
)
oracle(
    "group_quantile",
    union(
        [
            f"select mos, 'qty' as \"column\", cast({p} as double) as prob, {rnd(f'quantile_cont(qty, {p})', 'quantile', 4)} "
            "from gappy where mos is not null group by mos"
            for p in (0.1, 0.5, 0.9)
        ]
    ),
)
oracle(
    "column_quantile_by_counting",
    union(
        [
            f"select \"rank\", 'o_totalprice' as \"column\", cast({p} as double) as prob, "
            f"{rnd(f'quantile_cont(o_totalprice, {p})', 'quantile', 4)} from cohort group by \"rank\""
            for p in (0.1, 0.5, 0.9)
        ]
    ),
)
oracle(
    "grouped_means",
    "select mos, count(*) as n, "
    + ", ".join(rnd(f"avg({c})", f"mean_{c}", 4) for c in NUMERIC)
    + " from cohort group by mos",
)

# --- labels

oracle("label_binary", "select o_orderkey, returned as y_returned, low_flag as y_low_flag from cohort")
oracle(
    "label_flag_in_set",
    """
select o_orderkey, case when lower(mos) in ('machinery', 'furniture') then 1 else 0 end as y_in_set from gappy""",
)
oracle(
    "label_quantile",
    """
select o_orderkey, case when qty <= (select quantile_cont(qty, 0.25) from gappy) then 1 else 0 end as y_low_quarter
from gappy""",
)
oracle("label_threshold", "select o_orderkey, case when qty < 85 then 1 else 0 end as y_below from gappy")

# --- chart tables

oracle(
    "histogram30",
    """
select cast(b.i as integer) as bin, round(lo + b.i * w, 4) as lo, round(lo + b.i * w + w, 4) as hi,
       coalesce(n, 0) as n
from range(30) b(i) cross join bounds
left join (select least(cast(floor((o_totalprice - lo) / w) as integer), 29) as slot, count(*) as n
           from cohort cross join bounds group by 1) c on c.slot = b.i""",
    "bounds as (select min(o_totalprice) lo, (max(o_totalprice) - min(o_totalprice)) / 30 w from cohort)",
)
oracle(
    "box_by_group",
    """
select trend, round(q25, 4) as q25, round(q50, 4) as q50, round(q75, 4) as q75, count(*) as n,
       round(least(min(case when inside then qty end), q25), 4) as whisker_low,
       round(greatest(max(case when inside then qty end), q75), 4) as whisker_high,
       count(*) filter (where not inside) as n_outliers
from (select g.trend, qty, q25, q50, q75,
             qty between q25 - 1.5 * (q75 - q25) and q75 + 1.5 * (q75 - q25) as inside
      from gappy g join q on q.trend = g.trend where qty is not null)
group by trend, q25, q50, q75""",
    """q as (select trend, quantile_cont(qty, 0.25) q25, quantile_cont(qty, 0.5) q50,
              quantile_cont(qty, 0.75) q75 from gappy where qty is not null group by trend)""",
)
oracle(
    "density_by_group",
    """
select low_flag, point, round(x, 6) as x, round(sum(w * exp(-0.5 * ((x - v) / bw) * ((x - v) / bw)))
         / (total * bw * sqrt(2 * pi())), 6) as density
from (select s.low_flag, cast(p.i as integer) as point, bw, total,
             lo - 3 * bw + p.i * (hi + 3 * bw - (lo - 3 * bw)) / 199 as x
      from stats s cross join range(200) p(i)) grid
join (select low_flag as g, n_lines::double as v, count(*) as w from cohort group by 1, 2) d on d.g = grid.low_flag
group by low_flag, point, x, bw, total""",
    """stats as (select low_flag, stddev_samp(n_lines) * pow(count(*), -0.2) bw, min(n_lines)::double lo,
                        max(n_lines)::double hi, (select count(*) from cohort) total from cohort group by low_flag)""",
)
oracle(
    "pair_grid_points",
    union(
        [
            f"select o_orderkey, low_flag, '{a}' as x_name, '{b}' as y_name, round({a}::double, 6) as x, "
            f"round({b}::double, 6) as y, 500::bigint as n_shown, (select count(*) from cohort) as n_total from picked"
            for a in ("qty", "disc", "n_lines")
            for b in ("qty", "disc", "n_lines")
            if a != b
        ]
    ),
    f"picked as (select * from cohort order by {HASH} limit 500)",
)

oracle(
    "pair_grid_cells",
    union(
        [
            f"select '{a}' as x_name, '{b}' as y_name, low_flag, {bin30(a)} as x_bin, {bin30(b)} as y_bin, count(*) as n "
            f"from gappy, ends where {a} is not null and {b} is not null group by all"
            for a in ("qty", "n_lines", "o_totalprice")
            for b in ("qty", "n_lines", "o_totalprice")
            if a != b
        ]
    ),
    "ends as (select "
    + ", ".join(f"min({c})::double {c}_lo, max({c})::double {c}_hi" for c in ("qty", "n_lines", "o_totalprice"))
    + " from gappy)",
)


def density_sql(value: str, group: str, digits: int, extra: str = "") -> str:
    return f"""
select {group}, point, round(x, {min(digits, 6 if digits < 10 else 4)}) as x, round(sum(exp(-0.5 * ((x - v) / bw) * ((x - v) / bw)))
       / (any_value(total) * any_value(bw) * sqrt(2 * pi())), {digits}) as density{extra}
from (select s.{group}, cast(p.i as integer) as point, bw, total, lo - 3 * bw + p.i * (hi + 3 * bw - (lo - 3 * bw)) / 199 as x
      from (select {group}, stddev_samp({value}) * pow(count(*), -0.2) bw, min({value})::double lo, max({value})::double hi,
                   (select count(*) from cohort) total from cohort group by {group}) s cross join range(200) p(i)) grid
join (select {group} as g, {value}::double as v from cohort) d on d.g = grid.{group}
group by {group}, point, x"""


oracle("density_continuous", density_sql("o_totalprice", "trend", 12))
oracle(
    "pair_grid_diagonal",
    union([density_sql(c, "low_flag", 6, f", '{c}' as \"column\"") for c in ("n_lines", "qty")]),
)
oracle(
    "quantiles_of_odd_values",
    """
select "column", prob, printf('%.6e', case when a = b then a else a + (b - a) * (pos - floor(pos)) end) as quantile
from (select c."column", prob, prob * (len(vs) - 1) as pos, vs[floor(prob * (len(vs) - 1))::int + 1] a, vs[ceil(prob * (len(vs) - 1))::int + 1] b
      from (select "column", list(v order by v) vs from odd group by "column") c,
           (select unnest([0.002, 0.25, 0.5, 0.75, 0.998])::double prob) p)""",
    """odd as (
  select 'endless' as "column", case when o_orderkey % 97 = 0 then 'infinity'::double when o_orderkey % 101 = 0 then '-infinity'::double
                                     else o_totalprice end v from cohort
  union all select 'wide', o_totalprice * pow(10.0::double, (o_orderkey % 400 - 200)::double) from cohort
  union all select 'hot', case when o_orderkey % 3 > 0 then 7.0 else o_totalprice end from cohort)""",
)

# --- tests and association

oracle(
    "welch_decision",
    """
select round(t, 6) as t, round(dof, 6) as dof, round(p2, 6) as p_two_sided,
       round(case when t > 0 then p2 / 2 else 1 - p2 / 2 end, 6) as p_one_sided,
       case when case when t > 0 then p2 / 2 else 1 - p2 / 2 end < 0.05 then 'Reject H0' else 'Fail to reject H0' end as decision
from (select t, dof, 1 - 2 * sum(w * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi())
                               * pow(1 + x * x / dof, -(dof + 1) / 2)) * step / 3 as p2
      from (select *, abs(t) / 2000 as step, i * abs(t) / 2000 as x, case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end as w
            from (select (mh - ml) / sqrt(vh / nh + vl / nl) as t,
                         pow(vh / nh + vl / nl, 2) / (pow(vh / nh, 2) / (nh - 1) + pow(vl / nl, 2) / (nl - 1)) as dof
                  from (select count(qty) filter (where trend = 'P') nh, avg(qty) filter (where trend = 'P') mh, var_samp(qty) filter (where trend = 'P') vh,
                               count(qty) filter (where trend = 'F') nl, avg(qty) filter (where trend = 'F') ml, var_samp(qty) filter (where trend = 'F') vl
                        from gappy)), range(2001) r(i))
      group by t, dof, step)""",
)
oracle(
    "chi_square_p",
    """
select round(x, 6) as chi2, dof, round(1 - sum(w * case when i = 0 then 0 else exp((dof / 2.0 - 1) * ln(x * i / 4000) - x * i / 8000
         - lgamma(dof / 2.0)) / pow(2, dof / 2.0) end) * x / 12000, 6) as p
from (select n * (sum(o * o / (r * c)) - 1) as x, ((count(distinct "rank") - 1) * (count(distinct trend) - 1))::bigint as dof
      from (select "rank", trend, o::double o, sum(o) over (partition by "rank")::double r, sum(o) over (partition by trend)::double c, sum(o) over ()::double n
            from (select "rank", trend, count(*) o from cohort group by "rank", trend)) group by n),
     (select i, case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end as w from range(4001) r(i))
group by x, dof""",
)
oracle(
    "anova_p",
    """
select round(f, 6) as f, round(1 - sum(w * 2 * pow(sqrt(f) * i / 4000, d1 - 1) * exp(lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2)
         + d1 / 2 * ln(d1 / d2) - (d1 + d2) / 2 * ln(1 + d1 / d2 * f * pow(i / 4000, 2)))) * sqrt(f) / 12000, 6) as p
from (select d1, d2, (b / d1) / (v / d2) as f from (
        select count(*) - 1.0::double as d1, sum(n) - count(*)::double as d2, sum(n * pow(m - grand, 2)) as b, sum(n * v) as v
        from (select count(qty) n, avg(qty) m, var_pop(qty) v, (select avg(qty) from gappy where mos is not null) grand
              from gappy where mos is not null and qty is not null group by mos))),
     (select i::double i, case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end as w from range(4001) r(i))
group by f""",
)
oracle(
    "welch_test",
    """
select n_high, round(mean_high, 4) as mean_high, round(var_high, 4) as var_high,
       n_low, round(mean_low, 4) as mean_low, round(var_low, 4) as var_low,
       round(mean_high - mean_low, 4) as mean_difference,
       round((mean_high - mean_low) / sqrt(var_high / n_high + var_low / n_low), 4) as t,
       round(pow(var_high / n_high + var_low / n_low, 2)
             / (pow(var_high / n_high, 2) / (n_high - 1) + pow(var_low / n_low, 2) / (n_low - 1)), 4) as dof
from (select count(qty) filter (where trend = 'P') n_high, avg(qty) filter (where trend = 'P') mean_high,
             var_samp(qty) filter (where trend = 'P') var_high,
             count(qty) filter (where trend = 'F') n_low, avg(qty) filter (where trend = 'F') mean_low,
             var_samp(qty) filter (where trend = 'F') var_low from gappy)""",
)


def chi2_ctes(pairs: list[tuple[str, str]], table: str) -> str:
    """Contingency tables over the complete grid, cell by cell, with Yates' correction on 2 x 2."""

    def text(c: str) -> str:
        return f"coalesce(cast({col(c)} as varchar), 'Missing')"

    cells = union(
        [
            f"select '{a}' as a, '{b}' as b, {text(a)} as x, {text(b)} as y, count(*) as o from {table} group by 3, 4"
            for a, b in pairs
        ]
    )
    return f"""
cells as ({cells}),
xs as (select a, b, x, sum(o) as rx from cells group by a, b, x),
ys as (select a, b, y, sum(o) as cy from cells group by a, b, y),
dims as (select a, b, sum(o) as n, count(distinct x) as r, count(distinct y) as k from cells group by a, b),
gaps as (
  select d.a, d.b, d.n, d.r, d.k, rx * cy / d.n as e, abs(coalesce(o, 0) - rx * cy / d.n) as gap
  from dims d join xs on xs.a = d.a and xs.b = d.b join ys on ys.a = d.a and ys.b = d.b
  left join cells c on c.a = d.a and c.b = d.b and c.x = xs.x and c.y = ys.y),
chi as (
  select a, b, n, r, k,
         sum(case when r = 2 and k = 2 then pow(gap - least(0.5, gap), 2) else gap * gap end / e) as chi2
  from gaps group by a, b, n, r, k),
vs as (
  select *, case when least(r - pow(r - 1, 2) / (n - 1) - 1, k - pow(k - 1, 2) / (n - 1) - 1) <= 0 then 0.0
    else sqrt(greatest(chi2 / n - (k - 1) * (r - 1) / (n - 1), 0)
              / least(r - pow(r - 1, 2) / (n - 1) - 1, k - pow(k - 1, 2) / (n - 1) - 1)) end as v from chi)"""


oracle(
    "cramers_v",
    "select a, b, cast(n as bigint) as n, r, k, round(chi2, 6) as chi2, round(v, 6) as v from vs",
    chi2_ctes([("rank", "mos"), ("returned", "low_flag"), ("brigade_level", "division_level")], "gappy"),
)
_assoc = [*CATEGORICAL, "brigade_level", "returned", "low_flag"]
oracle(
    "association_matrix",
    union(
        [
            "select a, b, round(v, 6) as v from vs",
            "select b as a, a as b, round(v, 6) as v from vs",
            *[f"select '{c}' as a, '{c}' as b, 1.0::double as v" for c in _assoc],
        ]
    ),
    chi2_ctes([(a, b) for i, a in enumerate(_assoc) for b in _assoc[i + 1 :]], "gappy"),
)
oracle(
    "pearson_matrix",
    union(
        [f"select '{a}' as a, '{b}' as b, {rnd(f'corr({a}, {b})', 'r')} from gappy" for a in COUNTED for b in COUNTED]
    ),
)
oracle(
    "chi_square",
    """
select a, b, cast(n as bigint) as n, r, k, round(chi2, 4) as chi2, (r - 1) * (k - 1) as dof from vs""",
    chi2_ctes([("rank", "trend"), ("returned", "low_flag")], "cohort"),
)
oracle(
    "anova",
    """
select count(*) as "groups", cast(sum(n) as bigint) as n,
       round((sum(n * pow(m - (select sum(n * m) / sum(n) from g), 2)) / (count(*) - 1))
             / (sum(n * v) / (sum(n) - count(*))), 6) as f from g""",
    """g as (select mos, count(qty) n, avg(qty) m, var_pop(qty) v from gappy
             where mos is not null and qty is not null group by mos)""",
)

# --- splits and samples

oracle(
    "stratified_split",
    """
select o_orderkey, c.low_flag, case when place <= n_class - train then 1 else 0 end as is_test
from (select o_orderkey, low_flag, row_number() over (partition by low_flag order by h) place from hashed) c
join quotas q on q.low_flag = c.low_flag""",
    f"""hashed as (select *, {HASH} as h from cohort),
sizes as (select low_flag, count(*) n_class, sum(count(*)) over () n from cohort group by low_flag),
shares as (select *, n - ceil(0.2 * n) as train_total, n_class * (n - ceil(0.2 * n)) / n as exact from sizes),
quotas as (select low_flag, n_class, floor(exact)
             + case when row_number() over (order by round(exact - floor(exact), 9) desc, low_flag)
                         <= train_total - sum(floor(exact)) over () then 1 else 0 end as train from shares)""",
)
oracle(
    "random_split",
    f"""
select o_orderkey, case when row_number() over (order by {HASH}) <= ceil(0.2 * count(*) over ())
                        then 1 else 0 end as is_test from cohort""",
)
oracle(
    "fold_assign",
    f"select o_orderkey, cast(ntile(5) over (order by {HASH}) - 1 as integer) as fold from cohort",
)
oracle("sample_n", f"select o_orderkey, mos, n_lines from cohort order by {HASH} limit 1000")

# --- feature preparation

_z = "({c} - (select avg({c}) from cohort)) / (select stddev_pop({c}) from cohort)"
oracle(
    "standardize",
    "select o_orderkey, " + ", ".join(rnd(_z.format(c=c), f"z_{c}") for c in COUNTED) + " from cohort",
)
_hot = [("mos", v) for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")] + [("trend", v) for v in ("O", "P")]
oracle(
    "one_hot",
    f"select o_orderkey, {rnd(_z.format(c='disc'), 'z_disc')}, "
    + ", ".join(f"case when {c} = '{v}' then 1.0::double else 0.0::double end as {c}_{v.lower()}" for c, v in _hot)
    + " from cohort",
)

# --- scoring, units, scenarios

oracle(
    "score_linear",
    "select o_orderkey, " + ", ".join(rnd(m, m) for m in [*RISK_MODELS, "score"]) + " from scored",
    SCORED,
)
oracle(
    "risk_bands",
    "select o_orderkey, "
    + ", ".join(
        f"case when {m} >= 0.7 then 'high' when {m} >= 0.4 then 'moderate' else 'lower' end as band_{m}"
        for m in RISK_MODELS
    )
    + " from scored",
    SCORED,
)
oracle(
    "apply_thresholds",
    "select o_orderkey, "
    + ", ".join(f"case when {m} >= {t} then 1 else 0 end as hit_{m}" for m, t in THRESHOLDS.items())
    + " from scored",
    SCORED,
)
oracle("clamped_score", "select o_orderkey, round(least(greatest(score, 0), 150), 6) as score from scored", SCORED)
_null = "cast(null as double)"
oracle(
    "unit_summary",
    union(
        [
            f"select '{m}' as metric, 'risk_rate' as type, cast({t} as double) as threshold, "
            f"{rnd(f'avg({m})', 'avg_probability', 4)}, "
            f"{rnd(f'avg(case when {m} >= {t} then 1 else 0 end)', 'predicted_rate', 4)}, "
            f"{_null} as avg_pred, {_null} as p10, {_null} as p50, {_null} as p90 from scored"
            for m, t in THRESHOLDS.items()
        ]
        + [
            f"select 'score', 'regression', {_null}, {_null}, {_null}, round(avg(score), 4), "
            "round(quantile_cont(score, 0.1), 4), round(quantile_cont(score, 0.5), 4), "
            "round(quantile_cont(score, 0.9), 4) from scored"
        ]
    ),
    SCORED,
)
oracle(
    "prediction_percentiles",
    "select brigade_level, "
    + ", ".join(rnd(f"quantile_cont(score, {p / 100})", f"p{p}", 4) for p in (10, 50, 90))
    + " from scored group by brigade_level",
    SCORED,
)
oracle(
    "unit_risk_matrix",
    "select brigade_level, count(*) as n, "
    + ", ".join(rnd(f"avg(case when {m} >= {t} then 1 else 0 end)", m) for m, t in THRESHOLDS.items())
    + " from scored group by brigade_level",
    SCORED,
)
oracle(
    "mean_rates",
    union([f"select '{m}' as risk, {rnd(f'avg({m})', 'mean_rate')} from scored" for m in RISK_MODELS]),
    SCORED,
)
oracle(
    "roster_topk",
    """
select o_orderkey, brigade_level, "rank", round(price_risk, 6) as prob from scored
order by price_risk desc, o_orderkey limit 25""",
    SCORED,
)
oracle(
    "override_record",
    "select o_orderkey, qty, trend, returned, "
    + ", ".join(rnd(score(m), n) for n, m in RISK_MODELS.items())
    + " from picked",
    f"""picked as (select * replace (210.0::double as qty, 'P' as trend, 1 as returned)
                   from cohort order by {HASH}, o_orderkey limit 1)""",
)
_after = {
    c: f"least(greatest({c} + ({SCENARIO_OVERRIDES[c] - SCENARIO_BASE[c]!r}), {lo}), {hi})"
    for c, (lo, hi) in SCENARIO.ranges.items()
}
oracle(
    "scenario_shift",
    "select o_orderkey, " + ", ".join(rnd(e, c) for c, e in _after.items()) + ", 1 as low_flag from cohort",
)
oracle("shift_one_column", "select o_orderkey, round(least(greatest(qty - 60, 0), 100), 6) as qty from cohort")
BOTH = (
    "both_sides as (select "
    + ", ".join(f"{score(m)} as b_{n}, {score(m, _after)} as a_{n}" for n, m in RISK_MODELS.items())
    + " from cohort)"
)
oracle(
    "scenario_before_after",
    union(
        [
            f"select '{n}' as risk, round_even(avg(b_{n}) * 100, 1) as baseline_pct, "
            f"round_even(avg(a_{n}) * 100, 1) as after_pct, "
            f"round_even((avg(a_{n}) - avg(b_{n})) * 100, 1) as change_pp from both_sides"
            for n in RISK_MODELS
        ]
    ),
    BOTH,
)


def _rate(side: str, m: str) -> str:
    return f"avg(case when {side}_{m} >= {THRESHOLDS[m]} then 1 else 0 end)"


oracle(
    "scenario_by_threshold",
    union(
        [
            f"select '{n}' as risk, {rnd(f'avg(b_{n})', 'baseline_avg_prob')}, {rnd(f'avg(a_{n})', 'after_avg_prob')}, "
            f"{rnd(_rate('b', n), 'baseline_rate')}, {rnd(_rate('a', n), 'after_rate')}, "
            f"{rnd(_rate('a', n) + ' - ' + _rate('b', n), 'delta')} from both_sides"
            for n in RISK_MODELS
        ]
    ),
    BOTH,
)

# --- explanation


def _local(m: LinearScore, n: int) -> tuple[str, str]:
    terms = [(f"num__{c}", f"{coef} * (({c} - {mean}) / {std})") for c, mean, std, coef in m.numeric]
    terms += [
        (f"cat__{c}_{v}", f"case when {col(c)} = '{v}' then {coef} else 0.0 end") for c, v, coef in m.levels
    ]
    rows = union(
        [
            f"select o_orderkey, '{f}' as feature, cast({e} as double) as contribution from cohort"
            for f, e in terms
        ]
    )
    body = f"""
select o_orderkey, cast(place as integer) as place, feature, round(contribution, 6) as contribution,
       case when contribution >= 0 then '↑ increases' else '↓ decreases' end as direction
from (select *, row_number() over (partition by o_orderkey order by abs(contribution) desc, feature) as place
      from terms) where place <= {n}"""
    return body, f"terms as ({rows})"


oracle("local_contributions", *_local(RISK_MODELS["price_risk"], 4))
oracle("local_contributions_linear", *_local(SCORE_MODEL, 3))


def coefs(target: str) -> str:
    numbers = [
        f"select 'num__{c}' as feature, regr_slope({target}::double, {c}::double) * stddev_pop({c}) as coef from cohort"
        for c in COUNTED
    ]
    levels = [
        f"select 'cat__{c}_' || {col(c)}, avg({target}) - ((select sum({target}) from cohort) - sum({target})) "
        f"/ ((select count(*) from cohort) - count(*)) from cohort group by {col(c)}"
        for c in CATEGORICAL
    ]
    return f"coefs as ({union(numbers + levels)})"


ENDS = """ends as (
  select * from (select * from coefs order by coef desc, feature limit 5)
  union all select * from (select * from coefs order by coef, feature limit 5)),
named as (select regexp_replace(feature, '^(num__|cat__)', '') as feature_clean, coef from ends)"""
oracle(
    "top_drivers",
    """
select feature_clean, round(coef, 6) as coef, round(exp(coef), 6) as odds_ratio,
       round((exp(coef) - 1) * 100, 6) as pct_change_odds from named""",
    coefs("returned"),
    ENDS,
)
oracle("linear_drivers", "select feature_clean, round(coef, 6) as coef from named", coefs("qty"), ENDS)
oracle(
    "top_coefficients",
    """
select feature, round(coef, 6) as coef,
       case when coef > 0 then '↑ increases low price' else '↓ decreases low price' end as effect
from coefs order by abs(coef) desc, feature limit 10""",
    coefs("low_flag"),
)
oracle(
    "driver_text",
    """
select feature_clean, feature_clean || ': ' || case when exp(coef) > 1 then 'increases' else 'decreases' end
  || ' odds of returned by ~' || printf('%.0f', round_even(abs((exp(coef) - 1) * 100), 0))
  || '% (OR=' || printf('%.2f', exp(coef)) || ')' as text from named""",
    coefs("returned"),
    ENDS,
)
oracle(
    "linear_driver_text",
    """
select feature_clean, feature_clean || ': associated with ' || case when coef > 0 then 'HIGHER' else 'LOWER' end
  || ' qty (coef=' || printf('%.3f', coef) || ')' as text from named""",
    coefs("qty"),
    ENDS,
)

# --- evaluation

EVAL = f"""evaluated as (select o_orderkey, returned as y, qty, round({score(RISK_MODELS["return_risk"])}, 9) as p,
  {score(SCORE_MODEL)} as score, case when round({score(RISK_MODELS["return_risk"])}, 9) >= 0.7 then 1 else 0 end as pred
  from cohort)"""
SWEEP = (
    """sweep as (select threshold, cast(count(*) filter (where y = 1 and p >= threshold) as bigint) as tp,
       cast(count(*) filter (where y = 0 and p >= threshold) as bigint) as fp,
       cast(count(*) filter (where y = 1 and p < threshold) as bigint) as fn
  from evaluated cross join (select unnest(["""
    + ", ".join(f"{t!r}::double" for t in CANDIDATES)
    + """]) as threshold) group by threshold),
f1s as (select *, case when 2 * tp + fp + fn = 0 then 0.0 else 2 * tp / (2 * tp + fp + fn) end as f1 from sweep)"""
)
oracle(
    "threshold_sweep",
    "select round(threshold, 6) as threshold, tp, fp, fn, round(f1, 6) as f1 from f1s",
    EVAL,
    SWEEP,
)
oracle(
    "best_threshold",
    "select round(threshold, 6) as threshold, round(f1, 6) as f1 from f1s order by f1s.f1 desc, f1s.threshold limit 1",
    EVAL,
    SWEEP,
)
oracle(
    "confusion",
    union(
        [
            f"select {y} as label, {p} as pred, count(*) filter (where y = {y} and pred = {p}) as n from evaluated"
            for y in (0, 1)
            for p in (0, 1)
        ]
    ),
    EVAL,
)
REPORT = """c as (select count(*) filter (where y = 1 and pred = 1)::double tp, count(*) filter (where y = 0 and pred = 1)::double fp,
  count(*) filter (where y = 1 and pred = 0)::double fn, count(*) filter (where y = 0 and pred = 0)::double tn from evaluated),
m as (select *, coalesce(tn / nullif(tn + fn, 0), 0) p0, coalesce(tn / nullif(tn + fp, 0), 0) r0,
  coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) f0, coalesce(tp / nullif(tp + fp, 0), 0) p1,
  coalesce(tp / nullif(tp + fn, 0), 0) r1, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) f1,
  tn + fp s0, tp + fn s1, tp + fp + fn + tn n from c)"""


def _line(name: str, p: str, rec: str, f: str, s: str) -> str:
    return (
        f"select '{name}' as class, round({p}, 6) as precision, round({rec}, 6) as recall, round({f}, 6) as f1, "
        f"cast({s} as bigint) as support from m"
    )


_acc = "(tp + tn) / n"
oracle(
    "class_report",
    union(
        [
            _line("0", "p0", "r0", "m.f0", "s0"),
            _line("1", "p1", "r1", "m.f1", "s1"),
            _line("accuracy", _acc, _acc, _acc, "n"),
            _line("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(m.f0 + m.f1) / 2", "n"),
            _line("weighted avg", "(p0 * s0 + p1 * s1) / n", "(r0 * s0 + r1 * s1) / n", "(m.f0 * s0 + m.f1 * s1) / n", "n"),
        ]
    ),
    EVAL,
    REPORT,
)
oracle(
    "auc",
    """
select round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) as auc
from (select *, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) as below
      from (select p, count(*) filter (where y = 1) pos, count(*) filter (where y = 0) neg
            from evaluated group by p))""",
    EVAL,
)
oracle(
    "regression_metrics",
    """
select count(*) as n, round(sqrt(avg(pow(qty - score, 2))), 4) as rmse, round(avg(abs(qty - score)), 4) as mae,
       round(1 - sum(pow(qty - score, 2)) / (var_pop(qty) * count(*)), 4) as r2 from evaluated""",
    EVAL,
)
oracle(
    "residuals",
    "select o_orderkey, round(score, 6) as predicted, round(qty - score, 6) as residual from evaluated",
    EVAL,
)
oracle(
    "fit_linear",
    """
select 'num__qty' as feature, round((cy1 * v2 - cy2 * c12) / (v1 * v2 - c12 * c12) * sqrt(v1), 2) as coef,
       round(my, 2) as intercept from s
union all
select 'num__c_acctbal', round((cy2 * v1 - cy1 * c12) / (v1 * v2 - c12 * c12) * sqrt(v2), 2), round(my, 2) from s""",
    """s as (select avg(o_totalprice) my, var_pop(qty) v1, var_pop(c_acctbal) v2, covar_pop(qty, c_acctbal) c12,
              covar_pop(o_totalprice, qty) cy1, covar_pop(o_totalprice, c_acctbal) cy2 from cohort)""",
)

_slopes = """(cy1 * v2 - cy2 * c12) / (v1 * v2 - c12 * c12) as b1, (cy2 * v1 - cy1 * c12) / (v1 * v2 - c12 * c12) as b2"""
_moments = """avg(o_totalprice) my, avg(qty) m1, avg(c_acctbal) m2, var_pop(qty) v1, var_pop(c_acctbal) v2,
  covar_pop(qty, c_acctbal) c12, covar_pop(o_totalprice, qty) cy1, covar_pop(o_totalprice, c_acctbal) cy2"""
oracle(
    "fitted_linear_scores",
    """
select o_orderkey, round(my + b1 * (qty - m1) + b2 * (c_acctbal - m2), 2) as inline,
       round(my + b1 * (qty - m1) + b2 * (c_acctbal - m2), 2) as piped from gappy, line""",
    f"line as (select *, {_slopes} from (select {_moments} from cohort))",
)
oracle(
    "cv_linear",
    """
select fold, count(*) as n, round(sqrt(avg(pow(y - p, 2))), 4) as rmse, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 4) as r2
from (select f.fold, o_totalprice y, my + b1 * (qty - m1) + b2 * (c_acctbal - m2) p from folded f join lines l on l.left_out = f.fold)
group by fold""",
    f"folded as (select *, cast(ntile(5) over (order by {HASH}) - 1 as integer) as fold from cohort)",
    f"""lines as (select *, {_slopes} from (select i as left_out, {_moments} from folded, range(5) r(i)
                  where fold <> i group by i))""",
)

oracle(
    "fitted_drivers",
    """
select feature_clean, round(coef, 2) as coef
from (select 'qty' as feature_clean, b1 * sqrt(v1) as coef from line union all select 'c_acctbal', b2 * sqrt(v2) from line), range(2)""",
    f"line as (select *, {_slopes} from (select {_moments} from cohort))",
)

# Newton's method; the weights of the classes sum to the number of rows, the penalty is half the squared slope
_steps = ["x as (select (qty - avg(qty) over ()) / stddev_pop(qty) over () as x, returned as y,"
          " count(*) over () / (2.0 * count(*) over (partition by returned)) as w from cohort)",
          "t0 as (select 0.0::double as a, 0.0::double as b)"]
_steps += [
    f"""t{i} as (select a - (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01) as a, b - (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01) as b
  from (select a, b, sum(w * (p - y)) g0, sum(w * (p - y) * x) + b g1, sum(w * p * (1 - p)) h00, sum(w * p * (1 - p) * x) h01,
               sum(w * p * (1 - p) * x * x) + 1 h11 from (select *, 1 / (1 + exp(-a - b * x)) p from x, t{i - 1}) group by a, b))"""
    for i in range(1, 10)
]
oracle("logistic_coefficients", "select round(b, 3) as coef, round(a, 3) as intercept from t9", *_steps)


def stump(name: str, cells: str) -> tuple[str, ...]:
    """The best split of cells (n_lines, returned, n, s): one row of feature f, cut c and the means ml and mr."""
    return (
        f"""{name}_long as (select 'n_lines' f, n_lines::double v, n::double n, s from {cells}
  union all select 'returned', returned, n, s from {cells})""",
        f"""{name}_gains as (select f, c, sum(s) filter (where v <= c) sl, sum(n) filter (where v <= c) nl,
    sum(s) filter (where v > c) sr, sum(n) filter (where v > c) nr
  from {name}_long join (select distinct f, v c from {name}_long) using (f) group by f, c)""",
        f"""{name} as (select f, c, sl / nl ml, sr / nr mr from {name}_gains where nr is not null
  order by sl * sl / nl + sr * sr / nr desc limit 1)""",
    )


def by_stump(name: str) -> str:
    """What the stump says, where it is joined."""
    return f"case when case {name}.f when 'n_lines' then n_lines else returned end <= {name}.c then {name}.ml else {name}.mr end"


_cells = "cells as (select n_lines, returned, count(*) n, sum(qty) s from cohort group by n_lines, returned)"
oracle(
    "forest_stump",
    f"select n_lines, returned, n, round({by_stump('one')}, 6) as prediction from cells, one",
    _cells,
    *stump("one", "cells"),
)
oracle(
    "boosted_stumps",
    f"select n_lines, returned, n, round(p + 0.5 * {by_stump('two')}, 6) as prediction from again, two",
    _cells,
    *stump("one", "cells"),
    f"again as (select n_lines, returned, n, p, s - n * p as s from (select *, {by_stump('one')} p from cells, one))",
    *stump("two", "again"),
)
oracle(
    "stump_importance",
    """select 'num__' || x.f as feature, case when x.f = one.f then 1.0::double else 0.0::double end as importance
from (select distinct f from one_long) x, one""",
    _cells,
    *stump("one", "cells"),
)
oracle(
    "stump_attribution",
    f"""select o_orderkey, 'num__' || x.f as feature,
  round(case when x.f = one.f then {by_stump('one')} - (select avg(qty) from cohort) else 0.0::double end, 6) as value
from cohort, one, (select distinct f from one_long) x""",
    _cells,
    *stump("one", "cells"),
)


def boosted(cells: str, rounds: int = 2, depth: int = 2, rate: float = 0.5, penalty: float = 1.0) -> list[str]:
    """Second-order trees on cells (i, fits, n_lines, returned, n, s, p): for each i those that fit are learned from.

    The last table, ``done``, has the predictions p of all cells.  Nodes are numbered as in a heap; of equal gains the
    first feature's lowest cut is taken.
    """
    out, last = [], cells
    for k in range(1, rounds + 1):
        out.append(f"r{k}_0 as (select *, 0 node from {last})")
        for d in range(depth):
            x, at = f"r{k}_{d}", f"r{k}_{d + 1}"
            out += [
                f"""{x}_long as (select i, node, 0 f, n_lines::double v, n * p - s g, n::double h from {x} where fits
  union all select i, node, 1, returned, n * p - s, n from {x} where fits)""",
                f"{x}_bins as (select i, node, f, v, sum(g) g, sum(h) h from {x}_long group by i, node, f, v)",
                f"""{x}_cuts as (select i, node, f, v c, sum(g) over upto gl, sum(h) over upto hl, sum(g) over whole gt, sum(h) over whole ht
  from {x}_bins window upto as (partition by i, node, f order by v), whole as (partition by i, node, f))""",
                f"""{x}_gains as (select *, gl * gl / (hl + {penalty}) + (gt - gl) * (gt - gl) / (ht - hl + {penalty}) - gt * gt / (ht + {penalty}) gain
  from {x}_cuts where hl >= 1 and ht - hl >= 1)""",
                f"""{x}_best as (select * from {x}_gains where gain > 1e-6
  qualify row_number() over (partition by i, node order by round(gain, 6) desc, f, c) = 1)""",
                f"""{at} as (select x.* replace (case when b.c is null then -1 - node when case b.f when 0 then n_lines else returned end <= b.c
  then 2 * node + 1 else 2 * node + 2 end as node) from {x} x left join {x}_best b using (i, node))""",
            ]
            if d + 1 < depth:  # a node without a split stays as it is
                out[-1] = out[-1].replace("then -1 - node", "then node")
        x = f"r{k}_{depth}"
        out += [
            f"{x}_leaves as (select i, node, sum(n * p - s) g, sum(n) h from {x} where fits group by i, node)",
            f"r{k} as (select x.* exclude (node) replace (p - {rate} * coalesce(g / (h + {penalty}), 0) as p) from {x} x left join {x}_leaves using (i, node))",
        ]
        last = f"r{k}"
    return [*out, f"done as (select * from {last})"]


_one = "one_model as (select 0 i, true fits, *, sum(s) over () / sum(n) over () p from cells)"
oracle(
    "regularised_boosting",
    "select n_lines, returned, n, round(p, 6) as prediction from done",
    _cells,
    _one,
    *boosted("one_model"),
)
oracle(
    "cv_regularised_boosting",
    """
select fold, sum(n)::bigint as n, round(sqrt(sum(q - 2 * p * s + n * p * p) / sum(n)), 6) as rmse,
       round(1 - sum(q - 2 * p * s + n * p * p) / (sum(q) - sum(s) * sum(s) / sum(n)), 6) as r2
from done where not fits group by fold""",
    f"folded as (select *, cast(ntile(5) over (order by {HASH}) - 1 as integer) as fold from cohort)",
    "f as (select fold, n_lines, returned, count(*) n, sum(qty) s, sum(qty * qty) q from folded group by fold, n_lines, returned)",
    """models as (select i, fold <> i as fits, f.*, sum(s) filter (where fold <> i) over (partition by i)
  / sum(n) filter (where fold <> i) over (partition by i) as p from f, range(5) r(i))""",
    *boosted("models"),
)
oracle(
    "tree_scenario",
    """
select brigade_level, count(*) as n, round(avg(b.p), 5) as before, round(avg(a.p), 5) as after
from cohort c join done b on b.n_lines = c.n_lines and b.returned = c.returned
join done a on a.n_lines = least(c.n_lines + 1, 7) and a.returned = c.returned group by brigade_level""",
    _cells,
    """all_cells as (select n_lines, returned, coalesce(n, 0) n, coalesce(s, 0) s
  from (select distinct n_lines from cells) cross join (select distinct returned from cells) left join cells using (n_lines, returned))""",
    "one_model as (select 0 i, n > 0 fits, *, sum(s) over () / sum(n) over () p from all_cells)",
    *boosted("one_model"),
)
SQL["cv_linear_by_sums"] = SQL["cv_linear"]
oracle("boosted_attribution_adds_up", "select count(*) as n, 0::bigint as wrong from cohort")

# Newton's method with two slopes, for nine targets at a time
_nine = {name: e.replace("(rank =", '("rank" =') for name, e in NINE.items()}
_labels = " union all ".join(f"select '{t}' as target, {e} as y, x1, x2 from z" for t, e in _nine.items())
_newton = [
    """z as (select *, (qty - avg(qty) over ()) / stddev_pop(qty) over () as x1,
  (c_acctbal - avg(c_acctbal) over ()) / stddev_pop(c_acctbal) over () as x2 from cohort)""",
    f"ys as ({_labels})",
    "x as (select *, count(*) over (partition by target) / (2.0 * count(*) over (partition by target, y)) as w from ys)",
    "n0 as (select distinct target, 0.0::double a, 0.0::double b, 0.0::double c from ys)",
]
for _i in range(1, 11):
    _newton += [
        f"""h{_i} as (select target, any_value(a) a, any_value(b) b, any_value(c) c, sum(w * (p - y)) g0, sum(w * (p - y) * x1) + any_value(b) g1, sum(w * (p - y) * x2) + any_value(c) g2, sum(v) h00, sum(v * x1) h01,
  sum(v * x2) h02, sum(v * x1 * x1) + 1 h11, sum(v * x1 * x2) h12, sum(v * x2 * x2) + 1 h22
  from (select *, w * p * (1 - p) v from (select *, 1 / (1 + exp(-a - b * x1 - c * x2)) p from x join n{_i - 1} using (target))) group by target)""",
        f"""d{_i} as (select *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) d from h{_i})""",
        f"""n{_i} as (select target,
  a - (g0 * (h11 * h22 - h12 * h12) + g1 * (h02 * h12 - h01 * h22) + g2 * (h01 * h12 - h02 * h11)) / d as a,
  b - (g0 * (h12 * h02 - h01 * h22) + g1 * (h00 * h22 - h02 * h02) + g2 * (h01 * h02 - h00 * h12)) / d as b,
  c - (g0 * (h01 * h12 - h11 * h02) + g1 * (h01 * h02 - h00 * h12) + g2 * (h00 * h11 - h01 * h01)) / d as c from d{_i})""",
    ]
oracle(
    "logistic_nine_targets",
    "select target, round(a, 4) as intercept, round(b, 4) as qty, round(c, 4) as c_acctbal from n10",
    *_newton,
)
oracle(
    "auc_nine",
    """
select model, sum(pos + neg)::bigint as n, round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) as auc
from (select *, coalesce(sum(neg) over (partition by model order by p rows between unbounded preceding and 1 preceding), 0) as below
      from (select model, p, count(*) filter (where y = 1) pos, count(*) filter (where y = 0) neg from pairs group by model, p))
group by model""",
    SCORED,
    "pairs as ("
    + union([f"select '{m} of {y}' as model, {_nine.get(y, y)} as y, round({m}, 9) as p from scored" for m in RISK_MODELS for y in ("returned", "low_flag", "urgent")])
    + ")",
)

oracle("attribution_adds_up", "select count(*) as n, 0::bigint as wrong from cohort")
oracle(
    "cv_stump",
    """
select fold, sum(n)::bigint as n, round(sqrt(sum(q - 2 * p * s + n * p * p) / sum(n)), 6) as rmse,
       round(1 - sum(q - 2 * p * s + n * p * p) / (sum(q) - sum(s) * sum(s) / sum(n)), 6) as r2
from (select f.*, case when v <= c then ml else mr end p from f join best on best.i = f.fold) group by fold""",
    f"folded as (select *, cast(ntile(5) over (order by {HASH}) - 1 as integer) as fold from cohort)",
    "f as (select fold, n_lines v, count(*)::double n, sum(qty) s, sum(qty * qty) q from folded group by fold, n_lines)",
    """g as (select i, c, sum(s) filter (where v <= c) sl, sum(n) filter (where v <= c) nl, sum(s) filter (where v > c) sr,
         sum(n) filter (where v > c) nr from f, range(5) r(i), (select distinct v c from f) where fold <> i group by i, c)""",
    """best as (select i, c, sl / nl ml, sr / nr mr from g where nr is not null
  qualify row_number() over (partition by i order by sl * sl / nl + sr * sr / nr desc) = 1)""",
)

# --- screening

# power iteration on the correlations of four numbers
_four = ("o_totalprice", "c_acctbal", "qty", "n_lines")
_power = [
    "cor as (select " + ", ".join(f"corr({a}, {b}) as c{i}{j}" for i, a in enumerate(_four) for j, b in enumerate(_four)) + " from cohort)",
    """v as (with recursive it(i, v0, v1, v2, v3, size) as (
  select 0, 1.0::double, 0.9::double, 0.8::double, 0.7::double, 1.0::double
  union all select i + 1, w0 / z, w1 / z, w2 / z, w3 / z, z from (select i, w0, w1, w2, w3, sqrt(w0 * w0 + w1 * w1 + w2 * w2 + w3 * w3) z from (
    select i, """
    + ", ".join(f"c{j}0 * v0 + c{j}1 * v1 + c{j}2 * v2 + c{j}3 * v3 w{j}" for j in range(4))
    + " from it, cor where i < 300)))\n  select * from it where i = 300)",
]
oracle("component_shares", "select 1 as component, round(size / 4, 6) as share from v", *_power)
oracle(
    "component_loadings",
    union([f"select 1 as component, 'num__{c}' as feature, round(v{j} * sign(list_extract(list_sort([v0, v1, v2, v3], 'desc'), 1)), 5) as loading from v" for j, c in enumerate(_four)]),
    *_power,
)
oracle("kmeans_stable", "select count(*) as n, 0::bigint as strays, 0::bigint as moved from cohort")

oracle(
    "ordinal_levels",
    """
select o_orderkey, "rank", case "rank" when '5-LOW' then 0 when '4-NOT SPECIFIED' then 1
  when '3-MEDIUM' then 2 when '2-HIGH' then 3 else -1 end as rank_code from cohort""",
)
oracle(
    "row_totals",
    """
select o_orderkey, round(total, 6) as total, case when total >= 120 then 1 else 0 end as total_heavy,
       case when total >= 150 then 'heavy' when total >= 60 then 'medium' when total >= 0 then 'light' end as total_label
from (select o_orderkey, coalesce(qty, 0) + n_lines as total from gappy)""",
)
oracle(
    "duplicate_keys",
    """
select brigade_level, mos, n_lines, returned, count(*) as n from cohort
group by brigade_level, mos, n_lines, returned having count(*) > 1""",
)
oracle(
    "outlier_counts",
    union(
        [
            f"""select '{c}' as "column", round(any_value(lo), 4) as low, round(any_value(hi), 4) as high,
    count(*) filter (where {c} < lo or {c} > hi) as n_outside from cohort cross join (
      select q25 - 1.5 * (q75 - q25) as lo, q75 + 1.5 * (q75 - q25) as hi from (
        select quantile_cont({c}, 0.25) q25, quantile_cont({c}, 0.75) q75 from cohort))"""
            for c in NUMERIC
        ]
    ),
)
oracle(
    "range_checks",
    union(
        [
            f"select '{c}' as \"column\", {lo}::double as low, {hi}::double as high, "
            f"count(*) filter (where {c} < {lo} or {c} > {hi}) as n_outside from cohort"
            for c, lo, hi in (("qty", 10.0, 200.0), ("disc", 0.0, 0.08))
        ]
    ),
)
oracle(
    "minmax_scaled",
    "select o_orderkey, "
    + ", ".join(
        rnd(
            f"({c} - (select min({c}) from cohort)) / ((select max({c}) from cohort) - (select min({c}) from cohort))", c
        )
        for c in ("qty", "c_acctbal")
    )
    + " from cohort",
)
oracle(
    "zscore_scaled",
    "select o_orderkey, " + ", ".join(rnd(_z.format(c=c), c) for c in ("qty", "c_acctbal")) + " from cohort",
)

SQL["loaded_customers"] = "select c_custkey, c_name, c_mktsegment, c_acctbal from customer"
