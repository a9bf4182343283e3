"""The registered queries once more, as SQL for an independent engine."""

from __future__ import annotations

TX_ORDER = """tx as (
  select o_custkey as customer_id, o_orderdate as order_date, o_totalprice as unit_price from orders)"""
TX_EVENT = """tx as (
  select user_id as customer_id, ts as order_date, value as unit_price from events)"""
TX_UNDATED = """tx as (
  select * from (
    select user_id as customer_id, case when event_id % 5 <> 0 then ts end as order_date, value as unit_price from events)
  where customer_id in (select user_id from events where event_id % 5 <> 0 and ts is not null))"""
TX_DAY = """tx as (
  select user_id as customer_id, date_trunc('day', ts)::timestamp as order_date, value as unit_price from events)"""
TX_LINE = """tx as (
  select o_custkey as customer_id, l_partkey as product_id, o_orderdate as order_date,
         l_extendedprice as unit_price
  from lineitem join orders on l_orderkey = o_orderkey)"""
CUST_GAP = """gap as (
  select c_custkey as customer_id,
         case when c_custkey % 11 <> 0 then c_mktsegment end as grp,
         case when c_custkey % 7 <> 0 and c_mktsegment <> 'MACHINERY' then c_acctbal end as x
  from customer)"""
DOC_GAP = """docs as (
  select d.doc_id, d.lang, d.source, l.quality, l.toxic
  from documents d left join labels l on d.doc_id = l.doc_id)"""
RAW_TX = """raw as (
  select case when event_id % 101 = 0 then strftime(ts, '%Y-%m-%d') || '?'
              when event_id % 97 = 0 then strftime(ts, '%Y%m%d')
              else strftime(ts, '%Y-%m-%d') end as order_date,
         case when event_id % 53 <> 0 then cast(user_id as varchar) end as customer_id,
         case when event_id % 59 <> 0 then cast(event_id as varchar) end as product_id,
         case when event_id % 103 = 0 then '12,5'
              when event_id % 107 = 0 then null
              when event_id % 109 = 0 then '1.0d'
              when event_id % 113 = 0 then '2f'
              when event_id % 127 = 0 then 'Infinity'
              else cast(value as varchar) end as unit_price
  from events)"""
ARTICLES = """articles as (
  select lpad(cast(p_partkey as varchar), 10, '0') as product_id, p_name as product_name,
         'images/' || substr(lpad(cast(p_partkey as varchar), 10, '0'), 1, 3) || '/'
           || lpad(cast(p_partkey as varchar), 10, '0') || '.jpg' as image_path
  from part)"""
VEC = """vec as (
  select lpad(cast(vec_id as varchar), 10, '0') as product_id, vec_id,
         list_avg(list_transform(embedding, lambda v: cast(v as double))) as image_mean,
         list_stddev_pop(list_transform(embedding, lambda v: cast(v as double))) as image_std
  from embeddings)"""
PRODUCT_FEATURES = f"""{ARTICLES},
{VEC},
pf as (
  select a.product_id, a.image_path, cast(length(product_name) as integer) as product_name_length,
         image_mean, image_std
  from articles a left join vec v on a.product_id = v.product_id)"""
PRICE_FENCES = """q as (
  select quantile_cont(unit_price, 0.25) as q1, quantile_cont(unit_price, 0.5) as med,
         quantile_cont(unit_price, 0.75) as q3
  from tx),
f as (select *, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q)"""


def _rfm(tx: str, reference: str = "cast(max(order_date) as date) + interval 1 day") -> str:
    """Average ranks straight from the definition, over sorted windows."""
    return f"""{tx},
ref as (select cast({reference} as timestamp) as ref from tx),
base as (
  select customer_id,
         cast(floor(epoch_us(ref) / 86400e6 - epoch_us(max(order_date)) / 86400e6) as bigint) as recency,
         count(distinct order_date) as frequency,
         cast(coalesce(sum(cast(unit_price as decimal(18, 2))), 0) as double) as monetary
  from tx, ref where customer_id is not null group by customer_id, ref),
ranked as (
  select *, count(*) over () as n,
         2 * rank() over (order by recency desc) + count(*) over (partition by recency) - 1 as r2,
         2 * rank() over (order by frequency) + count(*) over (partition by frequency) - 1 as f2,
         2 * rank() over (order by monetary) + count(*) over (partition by monetary) - 1 as m2
  from base),
scored as (
  select *,
    cast(case when n = 1 then 4 when 2 * r2 <= n then 1 when r2 <= n then 2 when 2 * r2 <= 3 * n then 3 else 4 end as integer) as r_score,
    cast(case when n = 1 then 4 when 2 * f2 <= n then 1 when f2 <= n then 2 when 2 * f2 <= 3 * n then 3 else 4 end as integer) as f_score,
    cast(case when n = 1 then 4 when 2 * m2 <= n then 1 when m2 <= n then 2 when 2 * m2 <= 3 * n then 3 else 4 end as integer) as m_score
  from ranked),
rfm as (
  select customer_id, recency, frequency, monetary, r_score, f_score, m_score,
    case when r_score = 4 and f_score = 4 and m_score = 4 then 'VIP'
         when r_score >= 3 and f_score >= 3 then 'Loyal'
         when r_score = 4 and f_score <= 2 then 'New'
         when r_score = 1 then 'Churned'
         else 'Potential' end as segment
  from scored)"""


_RFM_ROWS = """select customer_id, recency, frequency, round(monetary, 2) as monetary,
       r_score, f_score, m_score, segment from rfm"""

_SUMMARY = """seg as (
  select segment, count(*) as customers, avg(recency) as mean_recency,
         avg(frequency) as mean_frequency, avg(monetary) as mean_monetary,
         cast(sum(cast(monetary as decimal(18, 2))) as double) as monetary_total
  from rfm group by segment),
summary as (
  select *, cast(customers as double) / (select sum(customers) from seg) * 100 as customer_share_pct,
         case when (select sum(monetary_total) from seg) = 0 then 0.0
              else monetary_total / (select sum(monetary_total) from seg) * 100 end as monetary_share_pct
  from seg)"""


def _filled(stat: str) -> str:
    return f"""with {CUST_GAP},
g as (select grp, {stat}(x) as s from gap group by grp),
a as (select {stat}(x) as s from gap)
select gap.customer_id, gap.grp, round(coalesce(gap.x, g.s, a.s), {{digits}}) as x
from gap left join g on gap.grp is not distinct from g.grp cross join a"""


def _profile(column: str) -> str:
    return f"""select '{column}' as column_name,
  count(*) - count({column}) as missing, count({column}) as count,
  round(avg({column}), 4) as mean, round(median({column}), 4) as median,
  round(coalesce(stddev_samp({column}), 0), 4) as std,
  round(quantile_cont({column}, 0.25), 4) as q1, round(quantile_cont({column}, 0.75), 4) as q3,
  round(min({column}), 4) as "min"
from lineitem"""


def _corr(x: str, y: str) -> str:
    c = f"corr({x}, {y})"
    return f"case when isnan({c}) then null else {c} end"


def _holdout(key: str, value: str, source: str, methods: dict[str, tuple[tuple[str, ...], str]]) -> str:
    parts = [
        f"""with k as (select *, cast({value} as double) as y,
  substr(md5(cast({key} as varchar)), 1, 2) < '33' as is_test from {source} where {value} is not null),
train as (select * from k where not is_test),
test as (select * from k where is_test)"""
    ]
    selects = []
    for i, (name, (by, stat)) in enumerate(methods.items()):
        parts.append(f"a{i} as (select {stat}(y) as s from train)")
        if by:
            cols = ", ".join(by)
            parts.append(f"g{i} as (select {cols}, {stat}(y) as s from train group by {cols})")
            on = " and ".join(f"test.{c} is not distinct from g{i}.{c}" for c in by)
            source_rows = f"test left join g{i} on {on} cross join a{i}"
            guess = f"coalesce(g{i}.s, a{i}.s)"
        else:
            source_rows, guess = f"test cross join a{i}", f"a{i}.s"
        selects.append(
            f"""select '{name}' as method, count(*) as test_rows,
  avg(abs({guess} - test.y)) as mae, sqrt(avg(({guess} - test.y) * ({guess} - test.y))) as rmse
from {source_rows}"""
        )
    return ",\n".join(parts) + ",\nerrors as (\n" + "\nunion all\n".join(selects) + ")\n"


def _count_sum(condition: str) -> str:
    return f"cast(count(*) filter (where {condition}) as bigint)"


_PAIRS = (
    ("image_mean", "image_std"),
    ("image_mean", "product_name_length"),
    ("image_std", "product_name_length"),
)
_FEATURES = ("image_mean", "image_std", "product_name_length")

ORACLES: dict[str, str] = {
    "normalize_customers": """
select cast(c_custkey as varchar) as customer_id,
       case when c_custkey % 7 <> 0 then c_acctbal end as age,
       case when c_custkey % 13 = 0 then null when c_custkey % 17 = 0 then 'NONE'
            else c_mktsegment end as club_member_status
from customer""",
    "normalize_articles": f"with {ARTICLES} select * from articles",
    "normalize_transactions": f"""with {TX_LINE}
select cast(customer_id as varchar) as customer_id, cast(product_id as varchar) as product_id,
       order_date, unit_price from tx""",
    "na_normalize": """
select p_partkey,
       case p_partkey % 20 when 2 then 'NONE' when 5 then 'Null' when 9 then ' '
            else case when p_partkey % 20 < 10 then null else p_brand end end as brand,
       case when p_partkey % 9 <> 0 then p_retailprice end as price
from part""",
    "load_summary": """
select (select count(*) from lineitem) as transaction_rows,
       (select count(*) from customer) as customer_rows,
       (select count(*) from part) as product_rows""",
    "dataset_inventory": f"""with {TX_LINE}, {CUST_GAP}, {PRODUCT_FEATURES}
select 'transactions' as table_name, 'one order line' as grain, (select count(*) from tx) as row_count,
       cast(4 as integer) as column_count, 'rfm and time series' as role
union all select 'customers', 'one customer', (select count(*) from gap), 3, 'attributes'
union all select 'articles', 'one product', (select count(*) from articles), 3, 'text'
union all select 'product_features', 'one product', (select count(*) from pf), 5, 'text and array statistics'""",
    "masked_preview": f"""with {TX_LINE}
select '<masked>' as customer_id, '<masked>' as product_id, order_date, unit_price
from (select * from tx order by order_date, product_id, customer_id, unit_price limit 5)""",
    "preview_profile": "\nunion all\n".join(
        _profile(c).replace(' as "min"', ' as "min", round(max(' + c + '), 4) as "max"')
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
    "dq_contract": """
with cols as (
  select table_name, column_name from information_schema.columns
  where table_name in ('orders', 'customer', 'part', 'events')),
need(table_name, column_name) as (values
  ('orders', 'o_orderkey'), ('orders', 'o_custkey'), ('orders', 'o_totalprice'),
  ('customer', 'c_custkey'), ('customer', 'age'), ('customer', 'club_member_status'),
  ('part', 'p_partkey'), ('part', 'p_name'), ('events', 'event_id'), ('events', 'ts')),
ban(table_name, column_name) as (values ('part', 'p_type'), ('part', 'p_container')),
counts as (
  select 'orders' as table_name, count(*) as row_count from orders
  union all select 'customer', count(*) from customer
  union all select 'part', count(*) from part
  union all select 'events', count(*) from events where event_type = 'no such event'),
m as (
  select n.table_name, string_agg(n.column_name, ', ' order by n.column_name) as missing
  from need n anti join cols c on n.table_name = c.table_name and n.column_name = c.column_name
  group by n.table_name),
b as (
  select n.table_name, string_agg(n.column_name, ', ' order by n.column_name) as removed
  from ban n semi join cols c on n.table_name = c.table_name and n.column_name = c.column_name
  group by n.table_name)
select counts.table_name, row_count, coalesce(missing, '') as missing_columns,
       coalesce(removed, '') as removed_columns,
       missing is null and removed is null and row_count > 0 as valid
from counts left join m on counts.table_name = m.table_name left join b on counts.table_name = b.table_name""",
    "dq_dimension_keys": """
with k as (
  select case when c_custkey % 23 <> 0 then substr(c_name, 10, 8) end as customer_id from customer),
c as (select customer_id, count(*) as n from k group by customer_id)
select cast(coalesce(sum(n) filter (where customer_id is null), 0) as bigint) as null_keys,
       count(*) filter (where customer_id is not null and n > 1) as duplicate_keys,
       cast(coalesce(sum(n) filter (where customer_id is not null and n > 1), 0) as bigint) as duplicate_rows
from c""",
    "dq_unparsable": f"""with {RAW_TX}
select 'order_date' as column_name,
       {_count_sum("order_date is not null and try_cast(order_date as timestamp) is null and try_strptime(order_date, '%Y%m%d') is null")} as unparsable from raw
union all
select 'unit_price', {_count_sum("unit_price is not null and not regexp_full_match(unit_price, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')")} from raw""",
    "dq_missing_ids": f"""with {RAW_TX}
select {_count_sum("customer_id is null or product_id is null")} as facts_with_missing_id from raw""",
    "dq_unknown_customer": """
select o_custkey as customer_id, count(*) as facts from orders
where o_custkey not in (select c_custkey from customer where c_custkey % 10 <> 0)
group by o_custkey""",
    "dq_unknown_article": """
select l_partkey as product_id, count(*) as facts from lineitem
where l_partkey not in (select vec_id from embeddings) group by l_partkey""",
    "impute_group_median": _filled("median").format(digits=6),
    "impute_group_mean": _filled("avg").format(digits=4),
    "impute_report": f"""with {CUST_GAP},
g as (select grp, median(x) as s from gap group by grp),
a as (select median(x) as s from gap)
select {_count_sum("gap.x is null")} as missing_before,
       {_count_sum("coalesce(gap.x, g.s, a.s) is null")} as missing_after
from gap left join g on gap.grp is not distinct from g.grp cross join a""",
    "missing_rate_profile": f"""with {DOC_GAP}
{" union all ".join(f"select '{c}' as column_name, round(avg(case when {c} is null then 1 else 0 end), 6) as missing_rate from docs" for c in ("lang", "source", "quality", "toxic"))}""",
    "group_profile": f"""with {CUST_GAP}
select grp, count(x) as known, round(avg(x), 4) as mean, round(median(x), 4) as median,
       round(case when count(x) > 2 then skewness(x) end, 4) as skewness,
       round(avg(x) - median(x), 4) as mean_median_gap
from gap where x is not null group by grp""",
    "holdout_imputer_mae": _holdout(
        "doc_id",
        "n_chars",
        "documents",
        {
            "global median": ((), "median"),
            "lang median": (("lang",), "median"),
            "source median": (("source",), "median"),
            "lang and source median": (("lang", "source"), "median"),
        },
    )
    + """select method, test_rows, round(mae, 4) as mae, round(rmse, 4) as rmse,
  round(((select mae from errors where method = 'global median') - mae)
    / (select mae from errors where method = 'global median') * 100, 4) as improvement_pct
from errors""",
    "holdout_mean_vs_median": _holdout(
        "c_custkey",
        "c_acctbal",
        "customer",
        {"group mean": (("c_mktsegment",), "avg"), "group median": (("c_mktsegment",), "median")},
    )
    + "select method, test_rows, round(mae, 4) as mae, round(rmse, 4) as rmse from errors",
    "impute_coverage": f"""with {DOC_GAP},
m as (
  select case when doc_id % 5 <> 0 then lang end as lang,
         case when doc_id % 7 <> 0 then source end as source
  from docs where quality is null)
select 'lang' as grouping_name, count(*) as missing_rows,
       round(avg(case when lang is not null then 1 else 0 end) * 100, 6) as coverage_pct from m
union all select 'source', count(*), round(avg(case when source is not null then 1 else 0 end) * 100, 6) from m
union all select 'lang and source', count(*),
       round(avg(case when lang is not null and source is not null then 1 else 0 end) * 100, 6) from m""",
    "group_policy": f"""with {CUST_GAP}
select grp, count(x) as training_rows, round(median(x), 6) as median,
       case when count(x) = 0 then 'global median' else 'group median' end as policy
from gap where not substr(md5(cast(customer_id as varchar)), 1, 2) < '33' group by grp""",
    "product_name_length": f"""with {ARTICLES}
select product_id, cast(length(product_name) as integer) as product_name_length from articles""",
    "image_stats": """
with lv as (
  select vec_id, list_transform(embedding, lambda v: cast(least(255, greatest(0, floor((cast(v as double) + 1) * 128))) as double)) as p
  from embeddings),
px as (
  select vec_id, case when vec_id % 2 = 1 then list_filter(p, lambda v, i: (i - 1) % 4 < 3) else p end as p from lv)
select vec_id, round(list_avg(p), 6) as image_mean, round(list_stddev_pop(p), 6) as image_std from px""",
    "packed_image_stats": """
with lv as (
  select vec_id, list_transform(embedding, lambda v: cast(least(255, greatest(0, floor((cast(v as double) + 1) * 128))) as double)) as p
  from embeddings),
px as (
  select vec_id, case when vec_id % 41 = 0 or vec_id % 43 = 0 or vec_id % 47 = 0 or vec_id % 53 = 0 then null
                      when vec_id % 2 = 1 then list_filter(p, lambda v, i: (i - 1) % 4 < 3) else p end as p from lv)
select vec_id, round(list_avg(p), 6) as image_mean, round(list_stddev_pop(p), 6) as image_std from px""",
    "packed_image_report": """
select case when vec_id % 41 = 0 then 'empty' when vec_id % 43 = 0 then 'unknown format'
            when vec_id % 47 = 0 then 'truncated' when vec_id % 53 = 0 then 'JPEG' else 'decoded' end as outcome,
       count(*) as images
from embeddings group by 1""",
    "array_stats": f"""with {VEC}
select product_id, round(image_mean, 6) as image_mean, round(image_std, 6) as image_std from vec""",
    "product_features": f"""with {PRODUCT_FEATURES}
select product_id, image_path, product_name_length, round(image_mean, 6) as image_mean,
       round(image_std, 6) as image_std from pf""",
    "iqr_statistics": f"""with {TX_EVENT}, {PRICE_FENCES}
select 'unit_price' as "column", cast(1.5 as double) as threshold, round(q1, 6) as q1, round(q3, 6) as q3,
       round(lo, 6) as lower_fence, round(hi, 6) as upper_fence,
       (select count(*) from tx, f where unit_price < lo or unit_price > hi) as outlier_count
from f""",
    "iqr_statistics_k3": """with q as (
  select quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.75) as q3 from lineitem),
f as (select *, q1 - 3 * (q3 - q1) as lo, q3 + 3 * (q3 - q1) as hi from q)
select 'l_extendedprice' as "column", cast(3 as double) as threshold, round(q1, 6) as q1, round(q3, 6) as q3,
       round(lo, 6) as lower_fence, round(hi, 6) as upper_fence,
       (select count(*) from lineitem, f where l_extendedprice < lo or l_extendedprice > hi) as outlier_count
from f""",
    "iqr_inliers": f"""with {TX_EVENT}, {PRICE_FENCES}
select customer_id, order_date, unit_price from tx, f where unit_price >= lo and unit_price <= hi""",
    "distinct_outliers": f"""with {TX_EVENT}, {PRICE_FENCES}
select distinct unit_price from tx, f where unit_price < lo or unit_price > hi order by unit_price""",
    "numeric_summary": f"""with {TX_EVENT}
select count(unit_price) as count, round(avg(unit_price), 6) as mean, round(median(unit_price), 6) as median,
       round(coalesce(stddev_samp(unit_price), 0), 6) as std, round(quantile_cont(unit_price, 0.25), 6) as q1,
       round(quantile_cont(unit_price, 0.75), 6) as q3, round(min(unit_price), 6) as "min",
       round(max(unit_price), 6) as "max"
from tx""",
    "price_histogram": f"""with {TX_EVENT},
e as (select min(unit_price) as lo, max(unit_price) as hi from tx),
edges as (
  select cast(i as integer) as bin,
         lo + i * ((hi - lo) / 40) as l,
         case when i = 39 then hi else lo + (i + 1) * ((hi - lo) / 40) end as r
  from e, range(40) t(i))
select bin, round(l, 6) as left_edge, round(r, 6) as right_edge,
       count(unit_price) as count
from edges left join tx on unit_price >= l and (unit_price < r or (bin = 39 and unit_price <= r))
group by bin, l, r""",
    "boxplot_before": f"""with {TX_EVENT}, {PRICE_FENCES}
select 'Before IQR' as label, round(q1, 6) as q1, round(med, 6) as med, round(q3, 6) as q3,
       round(min(unit_price), 6) as whislo, round(max(unit_price), 6) as whishi
from tx, f where unit_price >= lo and unit_price <= hi group by q1, med, q3""",
    "boxplot_after": f"""with {TX_EVENT.replace("tx as", "facts as")},
q0 as (select quantile_cont(unit_price, 0.25) as a, quantile_cont(unit_price, 0.75) as b from facts),
tx as (
  select facts.* from facts, q0 where unit_price >= a - 1.5 * (b - a) and unit_price <= b + 1.5 * (b - a)),
{PRICE_FENCES}
select 'After IQR' as label, round(q1, 6) as q1, round(med, 6) as med, round(q3, 6) as q3,
       round(min(unit_price), 6) as whislo, round(max(unit_price), 6) as whishi
from tx, f where unit_price >= lo and unit_price <= hi group by q1, med, q3""",
    "corr_price_age": f"""with {TX_ORDER}, {CUST_GAP},
g as (select grp, median(x) as s from gap group by grp),
a as (select median(x) as s from gap),
filled as (
  select customer_id, coalesce(gap.x, g.s, a.s) as x
  from gap left join g on gap.grp is not distinct from g.grp cross join a)
select round(coalesce({_corr("unit_price", "x")}, 0), 6) as correlation
from tx join filled on tx.customer_id = filled.customer_id""",
    "corr_price_feature": f"""with {VEC}
select round(coalesce({_corr("l_extendedprice", "image_mean")}, 0), 6) as correlation
from lineitem join vec on l_partkey = vec_id""",
    "corr_price_features": f"""with {VEC},
pf as (
  select p_partkey, p_size, p_retailprice, length(p_name) as name_length, image_mean, image_std
  from part left join vec on p_partkey = vec_id),
m as (select *, l_extendedprice as price from lineitem join pf on l_partkey = p_partkey)
"""
    + "\nunion all\n".join(
        f"select '{c}' as attribute, count(distinct l_partkey) filter (where {c} is not null) as keys, count({c}) as facts, "
        f"round(coalesce({_corr('price', c)}, 0), 6) as correlation from m"
        for c in ("p_size", "p_retailprice", "name_length", "image_mean", "image_std")
    ),
    "corr_image_text": f"""with {PRODUCT_FEATURES}
select round({_corr("image_mean", "product_name_length")}, 6) as correlation from pf""",
    "feature_corr_matrix": f"with {PRODUCT_FEATURES}\n"
    + "\nunion all\n".join(
        f"select '{a}' as feature_a, '{b}' as feature_b, round({_corr(a, b)}, 6) as correlation from pf"
        for a in _FEATURES
        for b in _FEATURES
    ),
    "strongest_pair": f"with {PRODUCT_FEATURES},\npairs as (\n"
    + "\nunion all\n".join(
        f"select '{a}' as feature_a, '{b}' as feature_b, {_corr(a, b)} as r from pf" for a, b in _PAIRS
    )
    + """)
select feature_a, feature_b, round(r, 6) as correlation from pairs
order by abs(r) desc nulls last, feature_a, feature_b limit 1""",
    "monthly_totals": f"""with {TX_ORDER}
select strftime(order_date, '%Y-%m') as order_month,
       round(cast(sum(cast(unit_price as decimal(18, 2))) as double), 2) as monetary
from tx where order_date is not null group by 1 order by 1""",
    "peak_month": f"""with {TX_ORDER}
select strftime(order_date, '%Y-%m') as order_month,
       round(cast(sum(cast(unit_price as decimal(18, 2))) as double), 2) as monetary
from tx where order_date is not null group by 1 order by 2 desc, 1 limit 1""",
    "correlation_labels": f"""with {TX_EVENT}, {CUST_GAP}, {VEC},
g as (select grp, median(x) as s from gap group by grp),
a as (select median(x) as s from gap),
filled as (
  select customer_id, coalesce(gap.x, g.s, a.s) as x
  from gap left join g on gap.grp is not distinct from g.grp cross join a),
r1 as (
  select coalesce({_corr("o_totalprice", "x")}, 0) as r from orders join filled on o_custkey = customer_id),
r2 as (
  select coalesce({_corr("l_extendedprice", "image_mean")}, 0) as r from lineitem join vec on l_partkey = vec_id)
select (select case when avg(unit_price) > median(unit_price) then 'right tail possible'
                    else 'no strong right tail' end from tx) as price_tail,
       (select case when abs(r) < 0.1 then 'very weak linear relation' else 'weak linear relation' end from r1) as price_age_strength,
       (select case when abs(r) < 0.1 then 'very weak linear relation' else 'weak linear relation' end from r2) as price_image_strength""",
    "corr_freq_monetary": f"""with {_rfm(TX_ORDER)}
select round({_corr("frequency", "monetary")}, 6) as correlation from base""",
    "freq_monetary_bins": f"""with {_rfm(TX_ORDER)},
e as (select min(frequency) as f0, max(frequency) as f1, min(monetary) as m0, max(monetary) as m1 from base)
select cast(least(19, floor(cast(frequency - f0 as double) / (f1 - f0) * 20)) as integer) as frequency_bin,
       cast(least(19, floor((monetary - m0) / (m1 - m0) * 20)) as integer) as monetary_bin,
       count(*) as customers
from base, e group by 1, 2""",
    "rfm_base": f"""with {_rfm(TX_ORDER)}
select customer_id, recency, frequency, round(monetary, 2) as monetary from base""",
    "rfm_percentile_ranks": f"""with {_rfm(TX_ORDER)},
k as (select customer_id, -recency as r, frequency as f, monetary as m from base)
select customer_id,
       round((rank() over (order by r) - 1 + (count(*) over (partition by r) + 1) / 2) / count(*) over (), 9) as r_rank,
       round((rank() over (order by f) - 1 + (count(*) over (partition by f) + 1) / 2) / count(*) over (), 9) as f_rank,
       round((rank() over (order by m) - 1 + (count(*) over (partition by m) + 1) / 2) / count(*) over (), 9) as m_rank
from k""",
    "rfm_scores": f"""with {_rfm(TX_ORDER)}
select customer_id, r_score, f_score, m_score from scored""",
    "rfm_segments": f"with {_rfm(TX_ORDER)} {_RFM_ROWS}",
    "rfm_bucketed_visits": f"with {_rfm(TX_ORDER)} {_RFM_ROWS}",
    "rfm_asof_date": f"with {_rfm(TX_ORDER, '''any_value(date '1999-06-30')''')} {_RFM_ROWS}",
    "rfm_lines": f"with {_rfm(TX_LINE)} {_RFM_ROWS}",
    "rfm_events": f"with {_rfm(TX_EVENT)} {_RFM_ROWS}",
    "rfm_some_undated": f"with {_rfm(TX_UNDATED)} {_RFM_ROWS}",
    "rfm_daily_events": f"with {_rfm(TX_DAY)} {_RFM_ROWS}",
    "customer_buckets": """
select cast(('0x' || substr(md5(cast(o_custkey as varchar)), 1, 8))::bigint % 64 as bigint) as bucket,
       count(distinct o_custkey) as customers, count(*) as facts
from orders group by 1""",
    "segment_summary": f"""with {_rfm(TX_ORDER)}, {_SUMMARY}
select segment, customers, round(mean_recency, 4) as mean_recency, round(mean_frequency, 4) as mean_frequency,
       round(mean_monetary, 4) as mean_monetary, round(monetary_total, 4) as monetary_total,
       round(customer_share_pct, 4) as customer_share_pct, round(monetary_share_pct, 4) as monetary_share_pct
from summary""",
    "segment_counts": f"with {_rfm(TX_ORDER)} select segment, count(*) as customers from rfm group by segment order by segment",
    "largest_segment": f"""with {_rfm(TX_ORDER)}
select segment, count(*) as customers from rfm group by segment order by customers desc, segment limit 1""",
    "insight_metrics": f"""with {_rfm(TX_ORDER)}, {_SUMMARY},
wanted(segment, metric) as (values
  ('VIP', 'customer_share_pct'), ('VIP', 'monetary_share_pct'), ('VIP', 'mean_frequency'),
  ('Churned', 'customer_share_pct'), ('Churned', 'mean_recency'), ('Churned', 'mean_frequency'),
  ('Loyal', 'customer_share_pct'), ('Loyal', 'monetary_share_pct'), ('Loyal', 'mean_frequency'))
select wanted.segment, metric,
       round(coalesce(case metric when 'customer_share_pct' then customer_share_pct
                                  when 'monetary_share_pct' then monetary_share_pct
                                  when 'mean_frequency' then mean_frequency
                                  else mean_recency end, 0), 4) as value
from wanted left join summary on wanted.segment = summary.segment""",
}
