"""DuckDB SQL for the registered queries that SQL can express, written independently of the operators."""

from __future__ import annotations

from quillpanel import fixed_values as V

ORACLES: dict[str, str] = {}

LINES = """
lines as (
  select c.c_custkey, c.c_nationkey, cast(year(o.o_orderdate) as integer) as period, o.o_orderkey, o.o_orderpriority,
         l.l_extendedprice, l.l_quantity, l.l_returnflag, l.l_linestatus
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey)"""

MEASURES = """
  round(sum(l_extendedprice), 2) / 1e6 as target, sum(l_quantity) as base,
  100e0 * avg(case when l_returnflag = 'R' then 1e0 else 0e0 end) as fossil_pct,
  100e0 * avg(case when l_linestatus = 'O' then 1e0 else 0e0 end) as renewable_pct"""

SECTOR_SUMS = ",\n  ".join(
    f"round(sum(case when o_orderpriority = '{v}' then l_extendedprice end), 2) / 1e6 as {k}"
    for k, v in {"s_urgent": "1-URGENT", "s_high": "2-HIGH", "s_medium": "3-MEDIUM", "s_low": "5-LOW"}.items()
)

NATION = f"""{LINES},
n0 as (select c_nationkey as entity, period, count(distinct c_custkey) as population, {MEASURES}, {SECTOR_SUMS}
       from lines group by all),
n as (select *, 100e0 * (base / nullif(lag(base) over (partition by entity order by period), 0) - 1) as growth_pct from n0)"""

CUSTOMER = f"""{LINES},
c0 as (select c_custkey as entity, period, count(distinct o_orderkey) as population, {MEASURES}, {SECTOR_SUMS}
       from lines group by all),
grid as (select c_custkey as entity, cast(y as integer) as period from customer cross join range(1995, 2002) t(y)),
c1 as (select * from grid left join c0 using (entity, period)),
c as (select *, 100e0 * (base / nullif(lag(base) over (partition by entity order by period), 0) - 1) as growth_pct from c1)"""


def r(expression: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({expression}, {digits}) + 0e0 as {name or expression}"


def add(name: str, panel: str | None, sql: str) -> None:
    """Registers ``sql``; a panel text becomes its leading WITH list (more CTEs may follow as ', x as (...)')."""
    ORACLES[name] = f"with {panel}{sql}" if panel else sql


METRICS = ["target", "base", "population", "fossil_pct", "renewable_pct", "growth_pct"]
SECTORS = ["s_urgent", "s_high", "s_medium", "s_low"]
T8 = r("target", 8)
REST = ", ".join(r(m) for m in METRICS[1:])
REST_N = ", ".join(r(m) for m in METRICS[1:5])
ONE = "'{0}' as metric"


def union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


def values(rows: list[tuple]) -> str:
    show = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return "(values " + ", ".join("(" + ", ".join(show(x) for x in row) + ")" for row in rows) + ")"


# sources and selection
LATEST = ", latest as (select * from n where period = (select max(period) from n))"
add("topk_cumulative_share", NATION, LATEST + f""",
top as (select *, target / (select sum(target) from latest) * 100 as share,
        row_number() over (order by target desc, entity) as rank_no from latest qualify rank_no <= 15)
select rank_no, entity, {T8}, {r('share', 6, 'share_pct')},
  {r('sum(share) over (order by rank_no rows unbounded preceding)', 6, 'cumulative_share_pct')} from top""")
add("panel_profile", CUSTOMER, """
select count(*) as n_rows, count(distinct entity) as n_entities, min(period) as first_period, max(period) as last_period,
  count(target) as n_target from c""")
add("latest_snapshot", NATION, LATEST + f" select entity, period, {T8}, {REST} from latest")
add("base_snapshot", NATION, f" select entity, period, {T8}, {REST} from n where period = (select max(period) from n) - 5")
add("exclude_members_anti", NATION, f" select entity, period, {T8}, {REST_N} from n where entity not in (20, 21, 22, 23, 24)")
add("keep_existing_columns", NATION, f" select entity, period, {r('base')} from n")
add("temporal_split_counts", CUSTOMER, """
select case when period <= 1999 then 'train' else 'test' end as part, count(*) as n_rows, min(period) as first_period,
  max(period) as last_period
from c where target is not null and base is not null and fossil_pct is not null and growth_pct is not null group by 1""")
add("row_loss_audit", CUSTOMER, """,
f as (select entity not in (20,21,22,23,24) as a, target is not null as b, growth_pct is not null as g,
             coalesce(fossil_pct > 0, false) as p from c)
select 1 as step_no, 'members' as step, count(*) as rows_in, count(*) filter (a) as rows_out from f
union all select 2, 'has_target', count(*) filter (a), count(*) filter (a and b) from f
union all select 3, 'has_growth', count(*) filter (a and b), count(*) filter (a and b and g) from f
union all select 4, 'positive_fossil', count(*) filter (a and b and g), count(*) filter (a and b and g and p) from f""")
add("catalog_search", None, """
with hits as (select term, p_partkey, p_name from part join (values ('small'), ('ring')) t(term)
              on contains(lower(p_name), lower(term)))
select term, count(*) over (partition by term) as n_matches,
  row_number() over (partition by term order by p_partkey) as rank_no, p_partkey, p_name from hits qualify rank_no <= 10""")
add("period_parse", NATION, union([
    f""" select entity as country_code, cast(replace(concat('YR', period), 'YR', '') as integer) as year,
  '{m}' as indicator, {r(m, 8, 'value')} from n""" for m in ("target", "base")]))
add("indicator_ingest", NATION, f"""
select cast(entity as varchar) as country_code, period as year, {T8}, {r('base')}, {r('growth_pct')},
  case when entity not in (3, 4) then round(fossil_pct, 6) + 0e0 end as fossil_pct from n
where period between 1996 and 2001""")
BAD = "fossil_pct is not null and entity in (3, 4)"
add("ingest_status", NATION, union([
    f""" select '{m}' as indicator, 'loaded' as status, count({m}) as rows, 0 as bad_rows, null as error from n where period between 1996 and 2001"""
    for m in ("target", "base", "growth_pct")] + [
    f""" select 'fossil_pct', 'loaded', count(*) filter (fossil_pct is not null and period between 1996 and 2001 and not ({BAD})),
  count(*) filter ({BAD}), concat(count(*) filter ({BAD}), ' rows could not be read') from n""",
    " select 'no_rows', 'failed', 0, 1, 'no header line with the columns that are needed'", " select 'not_there', 'failed', 0, 0, 'not found'"]))
add("long_ingest", NATION, f" select cast(entity as varchar) as country_code, period as year, {T8}, {r('growth_pct')} from n where period between 1996 and 2001")
add("csv_round_trip", NATION, f" select entity, period, {T8}, {REST_N} from n")
add("partitioned_round_trip", NATION, f" select entity, period, {T8}, {REST_N} from n where period between 1997 and 1999")
add("published_periods", NATION, f""" select entity, period, {T8},
  {r('base * case when period in (1997, 1999) then 2 else 1 end', 6, 'base')} from n""")
add("matrix_round_trip", NATION, union([
    f""" select '{x}' as x, {", ".join(r(f"corr({x}, {y})", 6, y) for y in METRICS[:3])} from n""" for x in METRICS[:3]]))

# assembly and gaps
PIVOT = ["target", "base", "fossil_pct", "growth_pct"]
add("panel_pivot", NATION, """, l as (""" + union(
    [f"select entity, period, '{m}' as k, cast({m} as double) as v from n where {m} is not null" for m in PIVOT]) + """)
select entity, period, """ + ", ".join(r(f"max(case when k = '{m}' then v end)", 8 if m == "target" else 6, m) for m in PIVOT)
    + " from l group by entity, period")
add("panel_outer_merge", NATION, f"""
, g as (select entity, period, concat('N', entity) as name, growth_pct from n where growth_pct is not null),
a as (select entity, period, target from n where target is not null),
b as (select entity, period, base from n where base is not null),
f as (select entity, period, fossil_pct from n where fossil_pct is not null)
select entity, period, name, {r('growth_pct')}, {T8}, {r('base')}, {r('fossil_pct')}
from g full join a using (entity, period) full join b using (entity, period) full join f using (entity, period)""")
add("entity_coverage", CUSTOMER, f" select entity, {r('count(target) / count(*)', 6, 'coverage')} from c group by entity")
add("column_null_pct", CUSTOMER, " select * from (" + union(
    [f"select '{m}' as metric, count(*) - count({m}) as n_missing, {r(f'100e0 * (count(*) - count({m})) / count(*)', 6, 'missing_pct')} from c"
     for m in METRICS]) + ") where n_missing > 0")
NULLS = " + ".join(f"(case when {m} is null then 1 else 0 end)" for m in METRICS)
add("missing_cells", CUSTOMER, f" select cast(sum({NULLS}) as bigint) as n_missing from c")
add("entity_missingness", CUSTOMER, f"""
select entity, {r(f'sum({NULLS}) / (6e0 * count(*))', 6, 'missing_share')} from c group by entity
having sum({NULLS}) / (6e0 * count(*)) > 0.5""")
add("entities_without_target", CUSTOMER, " select entity from c group by entity having count(target) = 0")


def gap_ctes(source: str, columns: list[str]) -> str:
    """CTEs ending in ``filled``: last value before and next value after each missing cell, then the limits."""
    seen = ", ".join(
        f"last_value({c} ignore nulls) over back as p_{c}, last_value(case when {c} is not null then rn end ignore nulls) over back as pr_{c}, "
        f"first_value({c} ignore nulls) over ahead as q_{c}, first_value(case when {c} is not null then rn end ignore nulls) over ahead as qr_{c}"
        for c in columns)
    filled = ", ".join(
        f"""case when {c} is not null then {c}
            when p_{c} is not null and q_{c} is null then case when rn - pr_{c} <= 5 then p_{c} end
            when p_{c} is not null and rn - pr_{c} <= 5
              then p_{c} + (q_{c} - p_{c}) * least(rn - pr_{c}, 3) / (qr_{c} - pr_{c})
            when q_{c} is not null and qr_{c} - rn <= 2 then q_{c} end as {c}"""
        for c in columns)
    return f""", numbered as (select *, row_number() over (partition by entity order by period) as rn from {source}),
seen as (select *, {seen} from numbered
  window back as (partition by entity order by period rows between unbounded preceding and current row),
         ahead as (partition by entity order by period rows between current row and unbounded following)),
filled as (select entity, period, {filled} from seen)"""


GAPS = gap_ctes("c", ["target", "base", "fossil_pct"]) + f"""
select entity, period, {r('target', 10)}, {r('base')}, {r('fossil_pct')} from filled"""
add("gap_fill", CUSTOMER, GAPS)
add("gap_fill_blocks", CUSTOMER, GAPS)
DERIVED = [r("ln(1 + base)", 6, "log_gdp"), r("ln(1 + population)", 6, "log_population"), r("ln(1 + target)", 6, "log_co2"),
           r("ln(1 + target / nullif(base / 1e9, 0))", 8, "log_co2_intensity")]
add("derived_features", NATION, f""" select entity, period, {", ".join(DERIVED)},
  {r('ln(1 + target * 1e9 / nullif(base, 0))', 8, 'log_scaled_intensity')} from n""")
CLEAN = f""", k0 as (select * from c where entity not in (20, 21, 22, 23, 24) and target is not null),
sparse as (select entity from k0 group by entity having sum({NULLS}) / (6e0 * count(*)) > 0.5),
kept as (select * from k0 where entity not in (select entity from sparse))""" + gap_ctes("kept", METRICS)
add("clean_panel", CUSTOMER, CLEAN + f" select entity, period, {T8}, {REST}, {', '.join(DERIVED)} from filled")
add("clean_panel_audited", CUSTOMER, CLEAN + f" select entity, period, {T8}, {REST}, {', '.join(DERIVED)} from filled")
add("clean_panel_audit", CUSTOMER, CLEAN + """ select 1 as step_no, 'members' as step, (select count(*) from c) as rows_in,
  (select count(*) from c where entity not in (20, 21, 22, 23, 24)) as rows_out
union all select 2, 'has_target', (select count(*) from c where entity not in (20, 21, 22, 23, 24)), (select count(*) from k0)
union all select 3, 'not_sparse', (select count(*) from k0), (select count(*) from kept)""")
add("clean_panel_kilotons", CUSTOMER, CLEAN + f""" select entity, period, {r('target', 8, 'co2_emissions_mt')}, {r('base')}, {r('growth_pct')},
  {r('ln(1 + target)', 6, 'log_co2')} from filled""")

# statistics
add("describe_numeric", CUSTOMER, union([f""" select '{m}' as metric, count({m}) as n, {r(f'avg({m})', 6, 'mean')},
  {r(f'stddev_samp({m})', 6, 'std')}, {r(f'min({m})', 6, 'min')}, {r(f'quantile_cont(cast({m} as double), 0.25)', 6, 'q25')},
  {r(f'quantile_cont(cast({m} as double), 0.5)', 6, 'q50')}, {r(f'quantile_cont(cast({m} as double), 0.75)', 6, 'q75')},
  {r(f'max({m})', 6, 'max')} from c""" for m in METRICS]))
add("corr_with_target", NATION, union(
    [f" select '{m}' as metric, {r(f'corr(target, {m})', 6, 'corr')} from n" for m in METRICS[1:]]))
add("corr_matrix", CUSTOMER, union([f" select '{a}' as x, '{b}' as y, {r(f'corr({a}, {b})', 6, 'corr')} from c"
    for i, a in enumerate(METRICS) for b in METRICS[: i + 1]]))
add("corr_products", CUSTOMER, union([f""" select '{a}' as x, '{b}' as y, {r(f'corr({a}, {b})', 6, 'corr')},
  count(*) filter ({a} is not null and {b} is not null) as n from c"""
    for i, a in enumerate([*METRICS, *SECTORS]) for b in [*METRICS, *SECTORS][: i + 1]]))
add("resolved_features", NATION, union(
    [f" select '{m}' as metric, {r(f'corr(target, {m})', 6, 'corr')} from n" for m in [*METRICS[1:], "s_urgent"]]))
add("period_totals", CUSTOMER, f" select period, {r('coalesce(sum(target), 0)', 8, 'total')} from c group by period")
add("global_ratio", NATION, f""" select {r('sum(s_urgent)', 8, 'part_total')}, {r('sum(target)', 8, 'whole_total')},
  {r('sum(s_urgent) / nullif(sum(target), 0) * 100', 6, 'part_pct')} from n""")
add("value_counts", None, "select o_orderpriority, count(*) as n from orders group by 1")

OUTCOME = """, ends as (
  select entity, max(case when period = 1995 then target end) as start_value, max(case when period = 2000 then target end) as end_value,
    case when count(growth_pct) >= 0.7e0 * 5 then round(product(1 + growth_pct / 100) - 1, 12) end as growth
  from c where period between 1995 and 2000 group by entity),
o as (select entity, start_value, end_value, (end_value - start_value) / start_value as change, growth,
  case when growth is null then 'insufficient_data'
       when (end_value - start_value) / start_value < -0.1e0 and growth > 0 then 'decoupling'
       when (end_value - start_value) / start_value < -0.1e0 then 'economic_contraction'
       else 'no_reduction' end as outcome
  from ends where start_value > 0 and end_value is not null),
lab as (select *, case when outcome = 'decoupling' then 1 else 0 end as success from o)"""
FEATURED = OUTCOME + f""", feat as (
  select c.entity, {", ".join("c." + m for m in METRICS)}, ln(1 + target) as log_target, ln(1 + base) as log_base,
    success, change, growth, outcome
  from c join lab on c.entity = lab.entity where c.period = 1996)"""
MEANS = FEATURED + ", diff as (select * from (" + union([f"""select '{m}' as feature,
  avg(case when success = 1 then {m} end) as success_mean, avg(case when success = 0 then {m} end) as other_mean from feat"""
    for m in METRICS]) + ") where success_mean is not null and other_mean is not null)"
add("class_mean_diff", CUSTOMER, MEANS + f""" select feature, {r('success_mean')}, {r('other_mean')},
  {r('success_mean - other_mean', 6, 'difference')} from diff""")
add("insight_rules", CUSTOMER, MEANS + """
select feature, case feature
  when 'base' then concat('Higher base (', printf('%.1f vs %.1f', success_mean, other_mean), ')')
  when 'population' then concat('More orders (', printf('%.2f vs %.2f', success_mean, other_mean), ')')
  when 'renewable_pct' then concat('Higher open share (', printf('%.1f%% vs %.1f%%', success_mean, other_mean), ')')
  else concat('Lower returned share (', printf('%.1f%% vs %.1f%%', success_mean, other_mean), ')') end as insight
from diff where (feature in ('base', 'population', 'renewable_pct') and success_mean > other_mean)
  or (feature = 'fossil_pct' and success_mean < other_mean)""")

# ranking
UNPIVOTED = lambda source: ", long as (" + union(
    [f"select entity, period, target, '{s}' as sector, {s} as amount, {s} / nullif(target, 0) * 100 as share from {source}" for s in SECTORS]) + ")"
add("sector_shares", NATION, UNPIVOTED("n") + f" select entity, period, sector, {r('amount', 8)}, {r('share', 6, 'share_pct')} from long")
add("topk_per_sector", CUSTOMER, UNPIVOTED("c") + f"""
select sector, row_number() over (partition by sector order by amount desc, concat(entity, '-', period)) as rank_no, entity, period,
  {r('amount', 8)}, {r('share', 6, 'share_pct')} from long where share > 50 qualify rank_no <= 5""")


def pct_rank(column: str, direction: str) -> str:
    return f"""case when {column} is not null then (rank() over (order by {column} {direction} nulls last)
      + (count(*) over (partition by {column}) - 1) / 2e0) / count({column}) over () end"""


add("pct_rank_avg", CUSTOMER, f""" select entity, period, {r(pct_rank('target', 'asc'), 8, 'target_rank')},
  {r(pct_rank('fossil_pct', 'desc'), 8, 'fossil_pct_rank')}, {r(pct_rank('base', 'asc'), 8, 'base_rank')} from c""")


def potential(fossil: str, others: str) -> str:
    parts = [f"{pct_rank('fossil_pct', fossil)} * 30", f"{pct_rank('renewable_pct', others)} * 30",
             f"{pct_rank('intensity', others)} * 20", f"{pct_rank('target', others)} * 20"]
    return f""", s as (select *, target * 1e9 / nullif(base, 0) as intensity from n where period = 2000),
big as (select * from s where target > 1),
scored as (select *, {" + ".join(parts)} as score from big)
select entity, {T8}, {r('fossil_pct')}, {r('renewable_pct')}, {r('score', 6, 'potential_score')}
from scored order by score desc nulls last, entity limit 15"""


add("potential_score", NATION, potential("asc", "desc"))
add("potential_score_corrected", NATION, potential("desc", "asc"))
TREND = """, recent as (select * from c where period <= 2000
  qualify row_number() over (partition by entity order by period desc) <= 5),
trend as (select entity, arg_min(target, period) filter (target is not null) as f, arg_max(target, period) filter (target is not null) as l
  from recent group by entity having count(*) >= 5 and count(target) >= 3),
prof as (select c.entity, c.period, c.target, c.target * 1e9 / nullif(c.base, 0) as intensity, (l - f) / nullif(f, 0) as change
  from c left join trend using (entity) where c.period = 2000)"""
add("endpoint_change", CUSTOMER, TREND + f" select entity, {r('(l - f) / nullif(f, 0)', 6, 'endpoint_change')} from trend")
add("trend_slope", CUSTOMER, TREND + f" select entity, {r('regr_slope(target, period)', 10, 'trend_slope')} from recent group by entity")
add("latest_profile", CUSTOMER, TREND + f" select entity, period, {T8}, {r('ln(1 + intensity)', 8, 'log_intensity')}, {r('change', 6, 'endpoint_change')} from prof")
add("quick_wins", CUSTOMER, TREND + f""" select entity, {T8}, {r('change', 6, 'endpoint_change')} from prof
where change < -0.05 and target > 0.1 order by change, entity limit 15""")
add("topk_union", NATION, LATEST + f"""
select entity, {T8}, population from latest where
  entity in (select entity from latest order by target desc, entity limit 5)
  or entity in (select entity from latest order by population desc, entity limit 5)""")
add("labelled_points", NATION, LATEST + f"""
, pts as (select * from latest where target > 0 and base > 0)
select entity, {T8}, {r('base')}, entity in (select entity from pts order by target desc, entity limit 5)
  or entity in (select entity from pts order by base desc, entity limit 5) as labelled from pts""")
add("top_entity_series", NATION, LATEST + f"""
select entity, period, {T8} from n where entity in (select entity from latest order by target desc, entity limit 5)""")

# outcome and segments
add("cumulative_growth", CUSTOMER, f"""
select entity, count(growth_pct) as n_rates,
  {r('case when count(growth_pct) >= 0.7e0 * 5 then ln(1 + round(product(1 + growth_pct / 100) - 1, 12)) end', 8, 'log_growth')}
from c where period between 1995 and 2000 group by entity""")
add("cumulative_growth_corrected", CUSTOMER, f"""
select entity, count(growth_pct) as n_rates,
  {r('case when count(growth_pct) >= 0.7e0 * 4 then ln(1 + round(product(1 + growth_pct / 100) - 1, 12)) end', 8, 'log_growth')}
from c where period between 1997 and 2000 group by entity""")
add("outcome_labels", CUSTOMER, OUTCOME + f""" select entity, {r('start_value', 8)}, {r('end_value', 8)}, {r('change')}, {r('ln(1 + growth)', 8, 'log_growth')},
  outcome, success from lab""")
add("outcome_counts", CUSTOMER, OUTCOME + " select outcome, count(*) as n from lab group by outcome")
add("outcome_share", CUSTOMER, OUTCOME + f""" select count(*) as n_total, cast(sum(success) as bigint) as n_success,
  {r('100e0 * sum(success) / count(*)', 6, 'success_pct')}, cast(count(*) - sum(success) as bigint) as n_other,
  {r('100e0 * (count(*) - sum(success)) / count(*)', 6, 'other_pct')} from lab""")
add("success_members", CUSTOMER, OUTCOME + """ select entity, printf('%+.1f%%', change * 100) as change,
  printf('%+.1f%%', growth * 100) as growth from lab where success = 1""")
add("outcome_extremes", CUSTOMER, OUTCOME + f""",
down as (select * from lab where outcome = 'decoupling' order by change, entity limit 10),
up as (select * from lab where outcome = 'no_reduction' order by change desc, entity limit 5)
select entity, outcome, {r('change')} from (select * from down union all select * from up)""")
FILL = lambda m: f"coalesce({m}, (select quantile_cont(cast({m} as double), 0.5) from feat))"
add("feature_matrix", CUSTOMER, FEATURED + f""" select entity, {r(FILL('target'), 9, 'target')},
  {", ".join(r(FILL(m), 6, m) for m in [*METRICS[1:], 'log_target', 'log_base'])}, success, {r('change')}, {r('ln(1 + growth)', 8, 'log_growth')}, outcome from feat""")
SEGMENTED = """, seg as (select *, case
    when base is null or target is null then 'Insufficient Data'
    when renewable_pct > 60 then 'Clean Energy Leader'
    when base > 200 and target > 0.45 then 'High-Income High-Emitter'
    when base > 200 then 'High-Income Low-Emitter'
    when base > 100 and fossil_pct > 30 then 'Middle-Income Fossil-Dependent'
    when base > 100 then 'Middle-Income Transitioning'
    else 'Low-Income' end as archetype from {0} where period = 2000)"""
SEG = SEGMENTED.format("c")
add("archetypes", CUSTOMER, SEG + f" select entity, archetype, {T8}, {r('base')}, {r('renewable_pct')} from seg")
add("archetype_totals", CUSTOMER, SEG + f""" select archetype, count(*) as n_entities, {r('coalesce(sum(target), 0)', 8, 'total')}
from seg group by archetype""")
add("archetype_examples", CUSTOMER, SEG + """ select archetype, array_to_string(list(entity order by entity)[1:5], ',') as members
from seg group by archetype""")
ACTIONS = values([(k, i, a) for k, v in V.ARCHETYPE_ACTIONS.items() for i, a in enumerate(v, 1)])
add("archetype_actions", CUSTOMER, SEG + f""" select entity, seg.archetype, priority, action
from seg join {ACTIONS} a(archetype, priority, action) on a.archetype = seg.archetype""")
SPLIT = union([f"select '{s}' as sector, sum({s}) as amount, sum({s}) / sum(target) * 100 as share from n" for s in SECTORS])
add("sector_split", NATION, f" select sector, {r('amount', 8)}, {r('share', 6, 'share_pct')} from ({SPLIT})")
SECTOR_ROWS = values([(s, k, i, a) for s, (k, v) in zip(SECTORS, V.SECTOR_ACTIONS.items()) for i, a in enumerate(v, 1)])
add("sector_actions", NATION, f""", split as ({SPLIT}) select a.role as sector, {r('amount', 8)}, priority, action
from split join {SECTOR_ROWS} a(sector, role, priority, action) on a.sector = split.sector""")
add("sector_report", NATION, f""", split as ({SPLIT}) select substr(sector, 3) as sector,
  concat(upper(substr(sector, 3, 1)), substr(sector, 4)) as title, upper(substr(sector, 3)) as heading,
  format('{{:,.2f}}', amount) as amount, printf('%.1f%%', share) as share from split""")

# scenario
OWNED = """case when {0} is null then 100 when {0} < 1000 then 20 when {0} < 5000 then 50 when {0} < 15000 then 200
  when {0} < 30000 then 400 when {0} < 50000 then 600 else 800 end"""
add("step_lookup", CUSTOMER, f""" select entity, period, {r('base * 100', 6, 'income')}, {OWNED.format('base * 100')} as ownership,
  {r(OWNED.format('base * 100') + ' * (population * 1e6) / 1000e0 / 1e6', 6, 'stock')} from c""")
RATE_CLASS = "case when {0} between 0 and 6 then 'high' when {0} between 7 and 19 then 'medium' else 'low' end"
RATE = "case when {0} between 0 and 6 then 0.2e0 when {0} between 7 and 19 then 0.08e0 else 0.02e0 end"
add("membership_lookup", NATION, f""" select entity, period, {RATE_CLASS.format('entity')} as rate_class,
  {r(RATE.format('entity'), 6, 'current_rate')}, {r('greatest(0.5e0 - ' + RATE.format('entity') + ', 0)', 6, 'gap')} from n""")


def binned(source: str, lowest: str) -> str:
    return f""", binned as (select *, case when fossil_pct {lowest} 0 and fossil_pct <= 20 then 1
  when fossil_pct > 20 and fossil_pct <= 40 then 2 when fossil_pct > 40 and fossil_pct <= 60 then 3
  when fossil_pct > 60 and fossil_pct <= 80 then 4 when fossil_pct > 80 and fossil_pct <= 100 then 5 end as bin_no from {source}),
named as (select * from binned join {values(list(enumerate(V.GRID_LABELS, 1)))} b(bin_no, bin) using (bin_no))"""


for name_, lowest_ in (("bin_counts", ">"), ("bin_counts_corrected", ">=")):
    add(name_, CUSTOMER, binned("c", lowest_) + " select bin_no, bin, count(*) as n from named group by all")
add("income_groups", CUSTOMER, """, i as (select case when base * 25 > 0 and base * 25 <= 1000 then 1
  when base * 25 > 1000 and base * 25 <= 4000 then 2 when base * 25 > 4000 and base * 25 <= 12000 then 3
  when base * 25 > 12000 then 4 end as group_no from c where period = 2000)
select group_no, case group_no when 1 then 'Low' when 2 then 'Lower-Middle' when 3 then 'Upper-Middle' else 'High' end as income_group,
  count(*) as n from i where group_no is not null group by all""")

ENRICHED = f""", e0 as (select * from c where period = 2000 and s_urgent is not null),
e as (select entity, s_urgent, target, coalesce(fossil_pct, (select avg(fossil_pct) from e0)) as fossil_pct,
  50e0 + coalesce(fossil_pct, (select avg(fossil_pct) from e0)) * 8e0 as grid_intensity,
  {OWNED.format('base * 100')} as ownership, {OWNED.format('base * 100')} * population / 1000e0 / 1e6 as stock_millions,
  {RATE_CLASS.format('entity')} as rate_class, {RATE.format('entity')} as current_rate,
  greatest(0.5e0 - {RATE.format('entity')}, 0) as remaining_gap from e0)"""
GRID = [("base", "all", "base", 0.45, 0.5, 120.0, 0.2)]
for p_, i_, levels_ in (("share", 3, (0.4, 0.45, 0.5)), ("adoption", 4, (0.3, 0.5, 0.7)), ("ref_per_km", 5, (100.0, 120.0, 150.0)),
                        ("use_per_km", 6, (0.15, 0.2, 0.25))):
    for level_, v_ in zip(("low", "base", "high"), levels_):
        row_ = [f"{p_}_{level_}", p_, level_, 0.45, 0.5, 120.0, 0.2]
        row_[i_] = v_
        GRID.append(tuple(row_))
GRID += [("best_case", "all", "best", 0.5, 0.7, 150.0, 0.15), ("worst_case", "all", "worst", 0.4, 0.3, 100.0, 0.25)]
CASES = f""", s0(scenario, parameter, level, share, adoption, ref_per_km, use_per_km) as {values(GRID)},
s as (select scenario, parameter, level, cast(share as double) as share, cast(adoption as double) as adoption,
  cast(ref_per_km as double) as ref_per_km, cast(use_per_km as double) as use_per_km from s0)"""
FORMULA = """, f as (select *, s_urgent * share as component_part, {0} as effective_rate, use_per_km * grid_intensity as unit_per_km,
  1 - use_per_km * grid_intensity / ref_per_km as factor from e cross join s where {1}),
x as (select *, component_part * effective_rate * factor as reduction from f)"""
GAP = "greatest(adoption - current_rate, 0)"
ONE_CASE = ENRICHED + CASES + FORMULA.format(GAP, "scenario = 'base'")
ALL_CASES = ENRICHED + CASES + FORMULA.format(GAP, "true")
add("scenario_entities", CUSTOMER, ONE_CASE + f"""
select entity, {r('grid_intensity')}, ownership, {r('stock_millions', 9)}, rate_class, {r('remaining_gap')}, {r('component_part')},
  {r('effective_rate')}, {r('unit_per_km')}, {r('factor')}, {r('reduction')}, {r('reduction / nullif(target, 0) * 100', 6, 'reduction_pct')},
  {r('reduction / nullif(s_urgent, 0) * 100', 6, 'component_reduction_pct')}, {r('reduction * (ownership / 200e0)', 6, 'reduction_scaled')} from x""")
SUMMARY = f"""
select count(*) as n_entities, {r('sum(s_urgent)', 8, 'component_total')}, {r('sum(component_part)', 6, 'component_part_total')},
  {r('sum(target)', 8, 'grand_total')}, {r('sum(reduction)', 6, 'reduction_total')},
  {r('sum(reduction) / nullif(sum(s_urgent), 0) * 100', 6, 'pct_of_component')},
  {r('sum(reduction) / nullif(sum(target), 0) * 100', 6, 'pct_of_total')}, {r('sum(stock_millions)', 8, 'stock_millions')},
  {r('avg(current_rate) * 100', 6, 'mean_current_pct')}, {r('avg(effective_rate) * 100', 6, 'mean_effective_pct')} from x"""
add("scenario_base", CUSTOMER, ONE_CASE + SUMMARY)
add("scenario_flat", CUSTOMER, ENRICHED + CASES + FORMULA.format("adoption", "scenario = 'base'") + SUMMARY)
add("adverse_entities", CUSTOMER, ONE_CASE + f" select entity, {r('grid_intensity')}, {r('unit_per_km')}, {r('factor')} from x where factor < 0")
add("top_reductions", CUSTOMER, ONE_CASE + f""" select row_number() over (order by reduction desc, entity) as rank_no, entity, {r('reduction')},
  {r('factor')}, {r('grid_intensity')} from x qualify rank_no <= 10""")
TOTALS = ALL_CASES + """, t as (select scenario, parameter, level, share, adoption, ref_per_km, use_per_km, sum(reduction) as total
  from x group by all)"""
add("scenario_grid", CUSTOMER, TOTALS + f""" select scenario, parameter, level, {r('share')}, {r('adoption')}, {r('ref_per_km')},
  {r('use_per_km')}, {r('total')} from t""")
add("scenario_vs_base", CUSTOMER, TOTALS + f""", b as (select total as bt from t where scenario = 'base')
select scenario, {r('total')}, {r('case when bt <> 0 then (total - bt) / bt * 100 else 0 end', 6, 'vs_base_pct')} from t, b""")
add("scenario_entity_grid", CUSTOMER, ALL_CASES + f" select entity, scenario, {r('effective_rate')}, {r('factor')}, {r('reduction')} from x")
TORNADO = TOTALS + """, w as (select parameter, max(case when level = 'low' then total end) as low_total,
  max(case when level = 'high' then total end) as high_total from t where parameter <> 'all' group by parameter)"""
add("tornado_ranges", CUSTOMER, TORNADO + f""" select parameter, {r('low_total')}, {r('high_total')},
  {r('abs(high_total - low_total)', 6, 'width')} from w""")
add("most_sensitive", CUSTOMER, TORNADO + f""" select parameter, {r('abs(high_total - low_total)', 6, 'width')} from w
order by abs(high_total - low_total) desc limit 1""")
BY_BIN = f""" select bin_no, bin, {r('sum(reduction)', 6, 'reduction_total')}, {r('sum(s_urgent)', 8, 'component_total')},
  {r('avg(factor)', 6, 'mean_factor')}, count(*) as n_entities, {r('sum(reduction) / nullif(sum(s_urgent), 0) * 100', 6, 'reduction_pct')}
from named group by bin_no, bin"""
add("scenario_by_bin", CUSTOMER, ONE_CASE + binned("x", ">") + BY_BIN)
add("scenario_by_bin_corrected", CUSTOMER, ONE_CASE + binned("x", ">=") + BY_BIN)
add("clean_dirty_totals", CUSTOMER, ONE_CASE + binned("x", ">") + f"""
select {r('coalesce(sum(case when bin_no <= 2 then reduction end), 0)', 6, 'clean_total')},
  {r('coalesce(sum(case when bin_no >= 4 then reduction end), 0)', 6, 'dirty_total')} from named""")

# models
add("elasticity_univariate", CUSTOMER, f"""
select count(*) as n, {r('regr_slope(ln(1 + target), ln(1 + base))', 6, 'slope')},
  {r('regr_intercept(ln(1 + target), ln(1 + base))', 6, 'intercept')},
  {r('regr_slope(ln(1 + target), ln(1 + base)) * stddev_pop(ln(1 + base))', 6, 'coef_standardised')}
from c where target is not null and base is not null""")
add("ridge_two_feature", None, f"""
with v as (select ln(1 + l_quantity) as a, l_discount as b, ln(1 + l_extendedprice) as y from lineitem),
m as (select count(*) as n, avg(a) as ma, avg(b) as mb, avg(y) as my, stddev_pop(a) as sa, stddev_pop(b) as sb,
  covar_pop(a, b) as cab, covar_pop(a, y) as cay, covar_pop(b, y) as cby from v),
e as (select *, n * cab / (sa * sb) as g, n * cay / sa as p, n * cby / sb as q, n + 10e0 as d from m),
w as (select *, (d * p - g * q) / (d * d - g * g) as w1, (d * q - g * p) / (d * d - g * g) as w2 from e)
select n, {r('w1', 6, 'coef1_standardised')}, {r('w2', 6, 'coef2_standardised')}, {r('w1 / sa', 6, 'coef1')}, {r('w2 / sb', 6, 'coef2')},
  {r('my - w1 / sa * ma - w2 / sb * mb', 6, 'intercept')} from w""")
add("shock_table", NATION, f""", b as (select entity, regr_slope(ln(1 + target), ln(1 + base)) as slope from n group by entity),
z as (select entity, slope, cast(f as double) as f from b cross join (values (1.05e0), (1.1e0), (1.2e0)) t(f))
select entity, {r('f', 2, 'factor')}, {r('slope')}, {r('pow(f, slope)', 6, 'multiplier')}, {r('(pow(f, slope) - 1) * 100', 6, 'change_pct')},
  {r('slope * (f - 1) * 100', 6, 'linear_pct')}, {r('abs((pow(f, slope) - 1) * 100 - slope * (f - 1) * 100)', 6, 'linear_error')},
  case when abs(slope) < 1 then 'inelastic' else 'elastic' end as response from z""")
LINE = """, pt as (select entity, period, ln(1 + target) as label, ln(1 + base) as log_base from c where target is not null),
k as (select regr_slope(label, log_base) as b1, regr_intercept(label, log_base) as b0 from pt),
pr as (select pt.*, b0 + b1 * log_base as prediction from pt, k)"""
CHANGES = LINE + """, ch as (select entity, exp(b0 + b1 * log_base) - 1 as baseline, exp(b0 + b1 * (log_base + ln(1.1e0))) - 1 as changed
  from pt, k where period = 2000),
cp as (select *, (changed - baseline) / nullif(baseline, 0) * 100 as change_pct from ch)"""
add("counterfactual_linear", CUSTOMER, CHANGES + f" select entity, {r('baseline')}, {r('changed')}, {r('change_pct')} from cp")
add("counterfactual_distribution", CUSTOMER, CHANGES + f"""
select count(change_pct) as n, {r('avg(change_pct)', 6, 'mean')}, {r('quantile_cont(change_pct, 0.5)', 6, 'median')},
  {r('stddev_pop(change_pct)', 6, 'std')}, {r('min(change_pct)', 6, 'min')}, {r('max(change_pct)', 6, 'max')},
  {r('avg(change_pct) - 2 * stddev_pop(change_pct)', 6, 'band_low')}, {r('avg(change_pct) + 2 * stddev_pop(change_pct)', 6, 'band_high')} from cp""")
add("standardise", CUSTOMER, f""", q as (select * from c where base is not null and fossil_pct is not null)
select entity, period, {r('(base - (select avg(base) from q)) / (select stddev_pop(base) from q)', 6, 'base')},
  {r('(fossil_pct - (select avg(fossil_pct) from q)) / (select stddev_pop(fossil_pct) from q)', 6, 'fossil_pct')} from q""")
add("median_impute", CUSTOMER, f""" select entity, period, {r('coalesce(target, (select quantile_cont(target, 0.5) from c))', 9, 'target')},
  {r('coalesce(growth_pct, (select quantile_cont(growth_pct, 0.5) from c))', 6, 'growth_pct')} from c""")
add("mean_impute", CUSTOMER, f""" select entity, period, {r('coalesce(target, (select avg(target) from c))', 8, 'target')},
  {r('coalesce(fossil_pct, (select avg(fossil_pct) from c))', 6, 'fossil_pct')} from c""")
add("balanced_weights", CUSTOMER, OUTCOME + f""" select entity, success,
  {r('count(*) over () / (2e0 * count(*) over (partition by success))', 6, 'weight')} from lab""")
add("regression_metrics", CUSTOMER, LINE + f""" select count(*) as n,
  {r('1 - sum((label - prediction) * (label - prediction)) / (count(*) * var_pop(label))', 6, 'r2')},
  {r('sqrt(avg((label - prediction) * (label - prediction)))', 6, 'rmse')}, {r('avg(abs(label - prediction))', 6, 'mae')},
  {r('avg(abs((label - prediction) / nullif(label, 0))) * 100', 6, 'mape')},
  {r('sqrt(avg((exp(label) - exp(prediction)) * (exp(label) - exp(prediction))))', 6, 'rmse_original')},
  {r('avg(abs(exp(label) - exp(prediction)))', 6, 'mae_original')} from pr""")
add("residuals", CUSTOMER, LINE + f""" select entity, period, {r('label')}, {r('prediction')}, {r('label - prediction', 6, 'residual')},
  {r('exp(label) - 1', 8, 'actual')}, {r('exp(prediction) - 1', 6, 'predicted')} from pr""")
SCORED = FEATURED + """, sc as (select entity, success as label, round(1 - fossil_pct / 100, 6) as score from feat where fossil_pct is not null),
pd as (select *, case when score >= 0.7e0 then 1 else 0 end as prediction from sc)"""
add("confusion_matrix", CUSTOMER, SCORED + """ select label as actual, count(*) filter (prediction = 0) as predicted_0,
  count(*) filter (prediction = 1) as predicted_1 from pd group by label""")
add("binary_metrics", CUSTOMER, SCORED + f""", k as (select count(*) filter (label = 1 and prediction = 1) as tp,
  count(*) filter (label = 0 and prediction = 1) as fp, count(*) filter (label = 1 and prediction = 0) as fn,
  count(*) filter (label = 0 and prediction = 0) as tn from pd)
select tp, fp, fn, tn, {r('(tp + tn) / (tp + fp + fn + tn)', 6, 'accuracy')}, {r('coalesce(tp / nullif(tp + fp, 0), 0)', 6, 'precision')},
  {r('coalesce(tp / nullif(tp + fn, 0), 0)', 6, 'recall')}, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 6, 'f1')} from k""")
add("auc_rank", CUSTOMER, SCORED + f""", rk as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2e0 as rk from sc)
select {r('''coalesce((sum(rk) filter (label = 1) - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2e0)
  / nullif(count(*) filter (label = 1) * count(*) filter (label = 0), 0), 0.5e0)''', 6, 'auc')} from rk""")
add("roc_points", CUSTOMER, SCORED + f""", g as (select score, count(*) filter (label = 1) as p, count(*) filter (label = 0) as q from sc group by score)
select {r('score', 6, 'threshold')}, {r('sum(q) over w / (select nullif(sum(q), 0) from g)', 6, 'fpr')},
  {r('sum(p) over w / (select nullif(sum(p), 0) from g)', 6, 'tpr')} from g
window w as (order by score desc rows unbounded preceding) union all select null, 0, 0""")
add("counterfactual_extremes", CUSTOMER, CHANGES + f""", hi as (select 'largest' as side, * from cp order by change_pct desc, entity limit 5),
lo as (select 'smallest' as side, * from cp order by change_pct, entity limit 5)
select side, entity, {r('baseline')}, {r('change_pct')} from (select * from hi union all select * from lo)""")
CLEAN_OUTCOME = OUTCOME.replace("from c where", "from filled where")
add("flagship", CUSTOMER, CLEAN + CLEAN_OUTCOME + SEGMENTED.format("filled") + f"""
select lab.entity, archetype, {r('start_value', 8)}, {r('end_value', 8)}, {r('change')}, {r('ln(1 + growth)', 8, 'log_growth')}, outcome, success
from lab join seg on lab.entity = seg.entity""")


# splits, ridge and logistic regression


def elimination(name: str, source: str, size: int, keep: str = "") -> str:
    """Query steps that solve the systems in columns m_<row>_<column> of ``source``; x_<row> is in ``name``."""
    steps, now = [], source
    for k in range(size):
        cells = []
        for i in range(size):
            for j in range(k + 1, size + 1):
                scaled = f"m_{k}_{j} / m_{k}_{k}"
                cells.append(f"{scaled if i == k else f'm_{i}_{j} - m_{i}_{k} * {scaled}'} as m_{i}_{j}")
        steps.append(f"{name}_{k} as materialized (select {keep}{', '.join(cells)} from {now})")
        now = f"{name}_{k}"
    return ", ".join(steps) + f", {name} as materialized (select {keep}{', '.join(f'm_{i}_{size} as x_{i}' for i in range(size))} from {now})"


HASHED = "('0x' || substr(md5(concat('42:', entity)), 1, 15))::bigint as h"
SPLIT_ROWS = FEATURED + f""", sized as (select *, sum(n) over () as total, ceil(sum(n) over () * {V.TEST_SHARE}) as w from (select success, count(*) as n from feat group by success)),
quota as (select success, floor(n * w / total) as q, row_number() over (order by floor(n * w / total) - n * w / total, success) as no, w - sum(floor(n * w / total)) over () as spare from sized),
numbered as (select *, row_number() over (partition by success order by h, entity) as place from (select *, {HASHED} from feat)),
parted as materialized (select numbered.*, case when place <= q + case when no <= spare then 1 else 0 end then 'test' else 'train' end as part from numbered join quota using (success))"""
FOLD_OF = "cast(case when place <= (n % 5) * (n // 5 + 1) then (place - 1) // (n // 5 + 1) else n % 5 + (place - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) end as integer) as fold"
add("stratified_split_rows", CUSTOMER, SPLIT_ROWS + " select entity, success, part from parted")
add("stratified_fold_rows", CUSTOMER, FEATURED + f""", numbered as (
  select *, row_number() over (partition by success order by h, entity) as place, count(*) over (partition by success) as n from (select *, {HASHED} from feat))
select entity, success, {FOLD_OF} from numbered""")

RIDGE_FEATURES = ["log_base", "population", "fossil_pct", "renewable_pct"]
_P = len(RIDGE_FEATURES)
_ALL = [*RIDGE_FEATURES, "label"]
_CELLS = ", ".join(f"covar_pop({a}, {b}) as c_{i}_{j}" for i, a in enumerate(_ALL) for j, b in enumerate(_ALL))
_SYSTEM = ", ".join(
    f"t.n * t.c_{i}_{j} / e.s_{i}" + (f" / e.s_{j}" if j < _P else "") + (" + alpha" if i == j else "") + f" as m_{i}_{j}" for i in range(_P) for j in range(_P + 1)
)
_PREDICTED = "t.mean_4 + " + " + ".join(f"x_{i} / e.s_{i} * ({f} - t.mean_{i})" for i, f in enumerate(RIDGE_FEATURES))
RIDGE = f""", ready as (
  select entity, period, ln(1 + target) as label, ln(1 + base) as log_base, population, fossil_pct, renewable_pct from c
  where target is not null and base is not null and population is not null and fossil_pct is not null and renewable_pct is not null),
numbered as (select *, row_number() over (order by entity, period) as place, count(*) over () as n from ready where period <= 1999),
folded as materialized (select * exclude (n), {FOLD_OF} from numbered),
tests as (
  select test, count(*)::double as n, {", ".join(f"avg({f}) as mean_{i}" for i, f in enumerate(_ALL))}, {_CELLS}
  from folded join range(-1, 5) t(test) on fold <> test group by test),
scales as (select {", ".join(f"sqrt(c_{i}_{i}) as s_{i}" for i in range(_P))}, {", ".join(f"mean_{i}" for i in range(_P + 1))} from tests where test = -1),
systems as (select t.test, alpha, {_SYSTEM} from tests t, scales e, (select unnest({[float(a) for a in V.RIDGE_ALPHAS]}::double[]) as alpha)),
{elimination("solution", "systems", _P, "test, alpha, ")},
held as (
  select alpha, fold, 1 - sum((label - prediction) * (label - prediction)) / (count(*) * var_pop(label)) as r2
  from (select f.*, x.alpha, {_PREDICTED} as prediction from folded f join solution x on x.test = f.fold join tests t on t.test = f.fold, scales e) group by alpha, fold),
scored as (select alpha, avg(r2) as mean_r2 from held group by alpha),
best as materialized (
  select x.*, e.*, e.mean_4 - ({" + ".join(f"x_{i} / e.s_{i} * e.mean_{i}" for i in range(_P))}) as intercept
  from solution x, scales e where test = -1 and alpha = (select alpha from scored order by mean_r2 desc, alpha limit 1))"""
_READING = {
    "log_base": "'1% base increase -> ' || printf('%.3f', {0}) || '% change'",
    "population": "'1 unit increase -> ' || printf('%.3f', {0}) || ' change in the log'",
    "fossil_pct": "'1 pp increase -> ' || printf('%.3f', {0}) || ' change in the log'",
    "renewable_pct": "'1 pp increase -> ' || printf('%.3f', {0}) || ' change in the log'",
}
add("ridge_cv", CUSTOMER, RIDGE + " " + union([
    f"""select '{f}' as feature, {r(f'x_{i}', 6, 'coef_standardised')}, {r(f'x_{i} / s_{i}', 6, 'elasticity')}, {_READING[f].format(f'x_{i}')} as reading,
  '{"Economic" if i < 2 else "Energy"}' as category, alpha, {r('intercept')} from best""" for i, f in enumerate(RIDGE_FEATURES)]))
add("ridge_cv_scores", CUSTOMER, RIDGE + f" select alpha, {r('mean_r2')} from scored")
_RIDGE_VALUE = "intercept + " + " + ".join(f"x_{i} / s_{i} * {f}" for i, f in enumerate(RIDGE_FEATURES))
add("ridge_test_metrics", CUSTOMER, RIDGE + f""", pr as (select label, {_RIDGE_VALUE} as prediction from ready, best where period > 1999)
select count(*) as n, {r('1 - sum((label - prediction) * (label - prediction)) / (count(*) * var_pop(label))', 6, 'r2')},
  {r('sqrt(avg((label - prediction) * (label - prediction)))', 6, 'rmse')}, {r('avg(abs(label - prediction))', 6, 'mae')},
  {r('avg(abs((label - prediction) / nullif(label, 0))) * 100', 6, 'mape')},
  {r('sqrt(avg((exp(label) - exp(prediction)) * (exp(label) - exp(prediction))))', 6, 'rmse_original')},
  {r('avg(abs(exp(label) - exp(prediction)))', 6, 'mae_original')} from pr""")
_CHANGED = _RIDGE_VALUE.replace("log_base", f"(log_base + ln({V.SHOCK}e0))")
add("counterfactual_ridge", CUSTOMER, RIDGE + f""", pr as (select entity, exp({_RIDGE_VALUE}) - 1 as baseline, exp({_CHANGED}) - 1 as changed from ready, best where period = 2000)
select entity, {r('baseline')}, {r('changed')}, {r('(changed - baseline) / nullif(baseline, 0) * 100', 6, 'change_pct')} from pr""")

CLASSED = ["log_target", "log_base", "population", "fossil_pct", "renewable_pct", "growth_pct"]
_ROUNDS = 14  # from 0 to where further ones change nothing in the printed digits
_K = len(CLASSED)
_ETA = "b_0 + " + " + ".join(f"b_{i + 1} * z_{i}" for i in range(_K))
_TERMS = ["1e0", *[f"z_{i}" for i in range(_K)]]
_MEDIAN = lambda m: f"coalesce({m}::double, (select quantile_cont({m}::double, 0.5) from parted where part = 'train'))"
STANDARD = SPLIT_ROWS + f""", filled as (select entity, success, part, h, {", ".join(f"{_MEDIAN(m)} as f_{i}" for i, m in enumerate(CLASSED))} from parted),
fitted as materialized (select count(*) as n, {", ".join(f"avg(f_{i}) as mean_{i}, stddev_pop(f_{i}) as dev_{i}" for i in range(_K))} from filled where part = 'train'),
amounts as (select success, count(*) as own from filled where part = 'train' group by success),
z as materialized (
  select entity, success, part, h, case when part = 'train' then n / (2e0 * own) else 1e0 end as w, {", ".join(f"(f_{i} - mean_{i}) / nullif(dev_{i}, 0) as z_{i}" for i in range(_K))}
  from filled join amounts using (success), fitted)"""


def logistic_steps(name: str, rows: str) -> str:
    """Rounds from ``name``_b0 to the coefficients b_0.. in ``name``; ``rows`` has success, w and z_0.. of what is fitted."""
    steps = [f"{name}_b0 as (select {', '.join(f'0e0 as b_{i}' for i in range(_K + 1))})"]
    for k in range(_ROUNDS):
        cells = [f"sum(v * {_TERMS[i]} * {_TERMS[j]}){' + 1' if i == j and i else ''} as m_{i}_{j}" for i in range(_K + 1) for j in range(_K + 1)]
        cells += [f"sum(e * {_TERMS[i]}){f' - any_value(b_{i})' if i else ''} as m_{i}_{_K + 1}" for i in range(_K + 1)]
        steps.append(f"""{name}_s{k} as materialized (select {", ".join(cells)} from (
  select *, w * p * (1 - p) as v, w * (success - p) as e from (select r.*, b.*, 1 / (1 + exp(-({_ETA}))) as p from {rows} r, {name}_b{k} b)))""")
        steps.append(elimination(f"{name}_x{k}", f"{name}_s{k}", _K + 1))
        steps.append(f"{name}_b{k + 1} as materialized (select {', '.join(f'b_{i} + x_{i} as b_{i}' for i in range(_K + 1))} from {name}_b{k}, {name}_x{k})")
    return ", ".join(steps) + f", {name} as (select * from {name}_b{_ROUNDS})"


F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"
TALLY = """count(*) filter (success = 1 and p > 0.5) as tp, count(*) filter (success = 0 and p > 0.5) as fp,
  count(*) filter (success = 1 and p <= 0.5) as fn, count(*) filter (success = 0 and p <= 0.5) as tn"""
LOGISTIC = STANDARD + f""", train as materialized (select * from z where part = 'train'), {logistic_steps("fit", "train")},
judged as materialized (select z.*, 1 / (1 + exp(-({_ETA}))) as p from z, fit)"""
add("logistic_classifier", CUSTOMER, LOGISTIC + f""",
tally as (select {TALLY} from judged where part = 'test'),
ranked as (select success, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2e0 as place from judged where part = 'test'),
area as (select coalesce((sum(place) filter (success = 1) - count(*) filter (success = 1) * (count(*) filter (success = 1) + 1) / 2e0)
  / nullif(count(*) filter (success = 1) * count(*) filter (success = 0), 0), 0.5e0) as auc from ranked)
select 0 as model_no, 'Logistic Regression' as model, {r("(select avg(case when (p > 0.5) = (success = 1) then 1e0 else 0e0 end) from judged where part = 'train')", 6, 'train_accuracy')},
  tp, fp, fn, tn, {r('(tp + tn) / (tp + fp + fn + tn)', 6, 'accuracy')}, {r('coalesce(tp / nullif(tp + fp, 0), 0)', 6, 'precision')},
  {r('coalesce(tp / nullif(tp + fn, 0), 0)', 6, 'recall')}, {r(F1, 6, 'f1')}, {r('auc')} from tally, area""")
add("logistic_importance", CUSTOMER, LOGISTIC + " " + union([
    f"select '{m}' as feature, {r(f'abs(b_{i + 1})', 6, 'importance')}, case when b_{i + 1} < 0 then -1 else 1 end as sign from fit" for i, m in enumerate(CLASSED)]))
add("logistic_cv_f1", CUSTOMER, STANDARD + f""",
numbered_train as (select *, row_number() over (partition by success order by h, entity) as place, count(*) over (partition by success) as n from z where part = 'train'),
folds as materialized (select *, {FOLD_OF} from numbered_train)"""
    + "".join(f", train{k} as materialized (select * from folds where fold <> {k}), {logistic_steps(f'fit{k}', f'train{k}')}" for k in range(5))
    + " " + union([f"select {k} as fold, {r(F1, 6, 'f1')} from (select {TALLY} from (select f.*, 1 / (1 + exp(-({_ETA}))) as p from folds f, fit{k} where fold = {k}))" for k in range(5)]))
