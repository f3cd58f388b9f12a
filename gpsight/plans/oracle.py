"""DuckDB SQL for each registered query (the correctness oracle).

Only the driver's base tables are registered in DuckDB, so every statement starts with the
practice views as CTEs. Where the Spark plan uses a rewrite (one-pass conditional
aggregation, prefix join, union-of-flags), the oracle keeps the form of the analysed code
(full outer join, two aggregates inner-joined, nineteen filters stacked, EXISTS), so the
comparison checks the rewrite, not a copy of it.

Agreement rules: money is summed as DECIMAL and cast to DOUBLE at the end; ``bround`` is
``round_even``; floating statistics are rounded (correlation outputs to 9 decimals).
"""

from __future__ import annotations

from gpsight.operators.register import AREAS
from gpsight.plans.queries import CHOSEN_PRACTICE

_AREA_VALUES = ",\n ".join(f"({i},'{p}','{a}')" for i, p, a in AREAS)

VIEWS = f"""
area_dim AS (
  select * from (values
 {_AREA_VALUES}) t(idx,prefix,area)),
address AS (
  select concat('W',case when length(cast(s_suppkey as string)) < 5 then lpad(cast(s_suppkey as string),5,'0') else cast(s_suppkey as string) end) practiceid,
         s_name name,
         concat(upper(substr(r_name,1,2)),cast(n_nationkey as string),' ',
                cast(s_suppkey % 10 as string),'AA') postcode
  from supplier
  join nation on s_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey),
gp_data AS (
  select concat('W',case when length(cast(l_suppkey as string)) < 5 then lpad(cast(l_suppkey as string),5,'0') else cast(l_suppkey as string) end) practiceid,
         cast(year(l_shipdate)*100+month(l_shipdate) as string) period,
         concat(case when length(cast(p_size % 15 + 1 as string)) < 2 then lpad(cast(p_size % 15 + 1 as string),2,'0') else cast(p_size % 15 + 1 as string) end,
                case when length(cast(p_partkey % 4 + 1 as string)) < 2 then lpad(cast(p_partkey % 4 + 1 as string),2,'0') else cast(p_partkey % 4 + 1 as string) end,
                case when length(cast(p_partkey % 3 + 1 as string)) < 2 then lpad(cast(p_partkey % 3 + 1 as string),2,'0') else cast(p_partkey % 3 + 1 as string) end,
                case when length(cast(p_partkey as string)) < 9 then lpad(cast(p_partkey as string),9,'0') else cast(p_partkey as string) end) bnfcode,
         case when p_name like 'red %' then concat('Metformin HCl_',substr(p_name,5))
              else p_name end bnfname,
         l_quantity quantity,
         cast(l_extendedprice as decimal(18,2)) nic,
         cast(l_extendedprice as decimal(18,2))*(1-cast(l_discount as decimal(4,2))) actcost
  from lineitem join part on l_partkey = p_partkey),
qof_achievement AS (
  with pl as (
    select concat('W',case when length(cast(l_suppkey as string)) < 5 then lpad(cast(l_suppkey as string),5,'0') else cast(l_suppkey as string) end) orgcode, o_custkey,
           concat(prefix,case when length(cast(p_partkey % 3 + 1 as string)) < 3 then lpad(cast(p_partkey % 3 + 1 as string),3,'0') else cast(p_partkey % 3 + 1 as string) end) indicator
    from lineitem
    join orders on l_orderkey = o_orderkey
    join part on l_partkey = p_partkey
    join area_dim on idx = p_size % 19),
  ls as (select orgcode, count(distinct o_custkey) field4 from pl group by orgcode),
  pr as (
    select pl.orgcode, indicator, count(distinct o_custkey) numerator, max(field4) field4
    from pl join ls on pl.orgcode = ls.orgcode
    group by pl.orgcode, indicator)
  select orgcode, indicator, numerator, field4 from pr
  union all
  select 'WAL', indicator, cast(sum(numerator) as bigint), cast(sum(field4) as bigint)
  from pr group by indicator)"""

CHOSEN = f"'{CHOSEN_PRACTICE}'"

# Building blocks written the way the analysed code computes them.
LIST_SIZE = "select orgcode practiceid, max(field4) total_pop from qof_achievement group by orgcode"
DM_PATIENTS = ("select orgcode practiceid, sum(numerator) diabetes_patients from qof_achievement "
               "where indicator like 'DM%' group by orgcode")
RATE_DM = f"""select coalesce(d.practiceid, p.practiceid) practiceid,
       cast(d.diabetes_patients as double) / cast(p.total_pop as double) rate_diabetes
from ({DM_PATIENTS}) d full join ({LIST_SIZE}) p on d.practiceid is not distinct from p.practiceid"""
TOTAL_QTY = ("select practiceid, sum(quantity) total_drugs_prescribed from gp_data "
             "group by practiceid")
MONTH = "cast(date_trunc('month', try_strptime(period, '%Y%m')) as date)"
MONTHLY = (f"select practiceid, {MONTH} AS month, sum(actcost) total_cost_meds from gp_data "
           "group by practiceid, month")
SPP = f"""select a.practiceid, a.postcode, c.total_costs, p.total_pop,
       c.total_costs / cast(p.total_pop as double) spend_per_patient
from address a
join (select practiceid, cast(sum(nic) as double) total_costs from gp_data group by practiceid) c
  on a.practiceid is not distinct from c.practiceid
join ({LIST_SIZE}) p on p.practiceid is not distinct from c.practiceid"""
INSULIN = "bnfcode like '060101%'"
METFORMIN = "lower(bnfname) like 'metformin%'"
KNOWN_IDS = ("select practiceid from (select practiceid from gp_data union "
             "select orgcode from qof_achievement union select practiceid from address) u "
             "where practiceid is not null")


def _share(where: str, num: str, name: str) -> str:
    return f"""select d.practiceid, d.{num} / t.total_drugs_prescribed {name}
from (select practiceid, sum(quantity) {num} from gp_data where {where} group by practiceid) d
join ({TOTAL_QTY}) t on d.practiceid is not distinct from t.practiceid"""


def _pairs(where: str, num: str, name: str) -> str:
    return f"""select r.practiceid, r.rate_diabetes, s.{name}
from ({RATE_DM}) r join ({_share(where, num, name)}) s on r.practiceid is not distinct from s.practiceid"""


def _pearson(pairs: str, x: str, y: str) -> str:
    """cor.test(x, y) in SQL: moments, r, t, df, two-sided p, 95 % CI.

    p by the finite trigonometric series for whole degrees of freedom: another method than the
    engine's integration, and no shared constants.
    """
    theta = "atan(abs(t) / sqrt(cast(df as double)))"
    even = (f"list_sum(list_transform(range(0, df // 2), lambda k: "
            f"exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(cos({theta}), 2 * k)))")
    odd = (f"list_sum(list_transform(range(0, (df - 1) // 2), lambda k: "
           f"exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow(cos({theta}), 2 * k + 1)))")
    inside = (f"(case when df = 1 then 2 * {theta} / pi() when df % 2 = 0 then sin({theta}) * {even} "
              f"else 2 / pi() * ({theta} + sin({theta}) * {odd}) end)")
    return f"""
with m as (
  select cast(regr_count({y}, {x}) as bigint) n, regr_sxx({y}, {x}) sxx,
         regr_syy({y}, {x}) syy, regr_sxy({y}, {x}) sxy
  from ({pairs}) q),
c as (select n, case when n >= 3 and sxx * syy > 0 then sxy / sqrt(sxx * syy) end r,
             n - 2 df from m),
d as (select n, r, df, abs(r) >= 1 perfect,
             case when abs(r) < 1 then r * sqrt(cast(df as double) / (1.0 - r * r)) end t
      from c),
e as (select *, case when perfect then 0.0
                     when df >= 1 and t is not null then least(1.0, 1.0 - {inside}) end p,
             1.959963984540054 / sqrt(cast(n - 3 as double)) half
      from d)
select n, round(r, 9) r, round(t, 9) t, case when n >= 3 then df end df, round(p, 9) p_value,
       round(case when n > 3 then (case when perfect then r else tanh(atanh(r) - half) end) end, 9) ci_low,
       round(case when n > 3 then (case when perfect then r else tanh(atanh(r) + half) end) end, 9) ci_high,
       p < 0.005 significant
from e"""


def _register_union() -> str:
    parts = [
        f"select orgcode practiceid, cast(sum(numerator) as bigint) patients, '{area}' area "
        f"from qof_achievement where orgcode like 'WAL%' and indicator like '{prefix}%' "
        f"group by orgcode"
        for _, prefix, area in AREAS
    ]
    return "\nunion all\n".join(parts)


def _profile() -> str:
    rate = "round_even((cast(dm as double) / cast(no_of_patients as double)) * 100.0, 1)"
    return f"""
with mo as (select practiceid, {MONTH} AS month, sum(actcost) c, sum(nic) n
            from gp_data group by practiceid, month),
r as (select practiceid, count(*) AS months, cast(sum(c) as double) tc,
             cast(sum(n) as double) total_costs from mo group by practiceid),
q as (select orgcode practiceid, max(field4) no_of_patients,
             coalesce(sum(case when indicator like 'DM%' then numerator end), 0) dm
      from qof_achievement group by orgcode),
b as (select r.practiceid, q.no_of_patients, r.months, r.tc / r.months avg_monthly_spend,
             round_even(floor(r.tc / r.months) / r.months, 1) avg_monthly_spend_compat,
             a.postcode, r.total_costs,
             r.total_costs / cast(q.no_of_patients as double) spend_per_patient,
             {rate} rate_pct
      from r join q on r.practiceid is not distinct from q.practiceid
      left join (select practiceid, min(postcode) postcode from address group by practiceid) a
        on a.practiceid is not distinct from r.practiceid),
ar as (select substring(postcode, 1, 2) area, count(*) area_practices,
              round(avg(spend_per_patient), 6) area_mean
       from b where postcode is not null group by area)
select b.*, ar.area_practices, ar.area_mean,
       (select {rate} from q where practiceid = 'WAL') national_rate_pct
from b left join ar on substring(b.postcode, 1, 2) = ar.area"""


def _report() -> str:
    two = lambda c, n: f"coalesce(cast(try_cast(round({c}, 6) as decimal(18,{n})) as string), 'unknown')"
    return f"""select practiceid, concat(coalesce(practiceid, 'unknown'), ' has ',
  coalesce(cast(no_of_patients as string), 'unknown'), ' patients. Average medication spend per month: ',
  {two("avg_monthly_spend", 2)}, ' (as computed by the original script: ', {two("avg_monthly_spend_compat", 1)},
  '). Spend per patient: ', {two("spend_per_patient", 2)},
  case when area_mean is null then '' else concat(' against a mean of ', {two("area_mean", 2)}, ' over ', area_practices,
    ' practices in postcode area ', substring(postcode, 1, 2)) end,
  '. Diabetes rate: ', {two("rate_pct", 1)}, '% (national: ', {two("national_rate_pct", 1)}, '%).') summary
from ({_profile()}) report"""


BODIES: dict[str, str] = {
    "scan_qof": "select orgcode, indicator, numerator, field4 from qof_achievement",
    "scan_address": "select practiceid, postcode from address",
    "practice_prescriptions": f"select * from gp_data where practiceid = {CHOSEN}",
    "practice_qof": f"select * from qof_achievement where orgcode = {CHOSEN}",
    "practice_address": f"select * from address where practiceid = {CHOSEN}",
    "qof_renamed": ("select orgcode practiceid, indicator, numerator, field4 no_of_patients "
                    "from qof_achievement"),
    "valid_practice_ids": (f"select practiceid, regexp_matches(practiceid, '^W[0-9]{{5}}$') is_valid "
                           f"from ({KNOWN_IDS}) ids"),
    "data_availability": f"""select ids.practiceid,
       exists (select 1 from gp_data g where g.practiceid = ids.practiceid) has_med,
       exists (select 1 from qof_achievement q where q.orgcode = ids.practiceid) has_qof
from ({KNOWN_IDS}) ids""",
    "check_practices": f"""select practiceid, is_valid, has_med, has_qof, has_med and has_qof has_both from (
  select ids.practiceid, regexp_matches(ids.practiceid, '^W[0-9]{{5}}$') is_valid,
         ids.practiceid in (select practiceid from gp_data where practiceid is not null) has_med,
         ids.practiceid in (select orgcode from qof_achievement where orgcode is not null) has_qof
  from ({KNOWN_IDS}) ids) checked""",
    "practices_with_both": """select distinct practiceid from gp_data
where practiceid in (select orgcode from qof_achievement)""",
    "practice_row_counts": f"""select ids.practiceid, coalesce(m.c, 0) med_rows, coalesce(q.c, 0) qof_rows
from ({KNOWN_IDS}) ids
left join (select practiceid, count(*) c from gp_data group by practiceid) m
  on m.practiceid = ids.practiceid
left join (select orgcode, count(*) c from qof_achievement group by orgcode) q
  on q.orgcode = ids.practiceid""",
    "list_size_one": f"select max(field4) total from qof_achievement where orgcode = {CHOSEN}",
    "list_size_by_practice": LIST_SIZE,
    "diabetes_patients": (f"select practiceid, cast(diabetes_patients as bigint) diabetes_patients "
                          f"from ({DM_PATIENTS}) d"),
    "diabetes_rate_one": f"""select round_even((cast(coalesce(sum(case when indicator like 'DM%' then numerator end), 0) as double)
                   / cast(max(field4) as double)) * 100.0, 1) rate_pct
from qof_achievement where orgcode = {CHOSEN}""",
    "diabetes_rate_by_practice": RATE_DM,
    "diabetes_rate_full_join": RATE_DM,
    "national_rate": f"select * from ({RATE_DM}) r where practiceid = 'WAL'",
    "rate_vs_national": f"select * from ({RATE_DM}) r where practiceid = 'WAL' or practiceid = {CHOSEN}",
    "total_cost_by_practice": ("select practiceid, cast(sum(nic) as double) total_costs from gp_data "
                               "group by practiceid"),
    "monthly_cost": (f"select practiceid, month, cast(total_cost_meds as double) total_cost_meds "
                     f"from ({MONTHLY}) m"),
    "avg_monthly_spend": f"""select practiceid, months, total / months avg_monthly_spend,
       round_even(floor(total / months) / months, 1) avg_monthly_spend_compat
from (select practiceid, count(*) AS months, cast(sum(total_cost_meds) as double) total
      from ({MONTHLY}) m group by practiceid) t""",
    "monthly_cost_per_patient": f"""select m.practiceid, m.month,
       cast(m.total_cost_meds as double) total_cost_meds,
       floor(cast(m.total_cost_meds as double) / cast(p.total_pop as double)) avg_cost
from ({MONTHLY}) m join ({LIST_SIZE}) p on m.practiceid is not distinct from p.practiceid""",
    "spend_per_patient": SPP,
    "spend_per_patient_area": f"""select s.*, s.practiceid = {CHOSEN} is_chosen from ({SPP}) s
where regexp_matches(s.postcode, '^' ||
      (select min(substring(postcode, 1, 2)) from ({SPP}) c where c.practiceid = {CHOSEN}))""",
    "area_peer_stats": f"""select practiceid, substring(postcode, 1, 2) area, spend_per_patient,
       count(*) over (partition by substring(postcode, 1, 2)) area_practices,
       round(avg(spend_per_patient) over (partition by substring(postcode, 1, 2)), 6) area_mean
from ({SPP}) s""",
    "area_practice_counts": f"""select practiceid, count(*) n from ({SPP}) s
where regexp_matches(s.postcode, '^' ||
      (select min(substring(postcode, 1, 2)) from ({SPP}) c where c.practiceid = {CHOSEN}))
group by practiceid""",
    "practice_row_share": f"""select practiceid,
       cast(count(*) as double) / sum(count(*)) over (partition by practiceid) prop
from ({RATE_DM}) r group by practiceid""",
    "total_quantity_by_practice": TOTAL_QTY,
    "insulin_rows": f"select * from gp_data where {INSULIN}",
    "metformin_rows": f"select * from gp_data where {METFORMIN}",
    "insulin_quantity": (f"select practiceid, sum(quantity) insulin_prsc from gp_data where {INSULIN} "
                         "group by practiceid"),
    "metformin_quantity": (f"select practiceid, sum(quantity) met_prsc from gp_data where {METFORMIN} "
                           "group by practiceid"),
    "insulin_rate": _share(INSULIN, "insulin_prsc", "rate_insulin"),
    "metformin_rate": _share(METFORMIN, "met_prsc", "rate_metformin"),
    "diabetes_insulin_pairs": _pairs(INSULIN, "insulin_prsc", "rate_insulin"),
    "diabetes_metformin_pairs": _pairs(METFORMIN, "met_prsc", "rate_metformin"),
    "cor_diabetes_insulin": _pearson(_pairs(INSULIN, "insulin_prsc", "rate_insulin"),
                                     "rate_diabetes", "rate_insulin"),
    "cor_diabetes_metformin": _pearson(_pairs(METFORMIN, "met_prsc", "rate_metformin"),
                                       "rate_diabetes", "rate_metformin"),
    "disease_register": _register_union(),
    "disease_register_union": _register_union(),
    "practice_profile": _profile(),
    "practice_report": _report(),
}


def oracle_sql() -> dict[str, str]:
    """name -> one DuckDB statement: the practice views as CTEs, then the query."""
    return {name: f"WITH {VIEWS}\nSELECT * FROM (\n{body}\n) oracle_result"
            for name, body in BODIES.items()}
