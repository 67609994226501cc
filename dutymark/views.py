"""Product, tariff and event tables derived from the given tables; the SQL runs in Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_catalog": """
select cast(p_partkey as bigint) as id, upper(p_name) || ' ' || cast(p_size as string) || 'G' as description,
  case when p_partkey % 4 = 1 then lpad(cast(1 + p_partkey % 97 as string), 2, '0') || lpad(cast(p_size as string), 2, '0') || '10'
       when p_partkey % 4 = 2 then lpad(cast(1 + p_partkey % 97 as string), 2, '0') || lpad(cast(p_size as string), 2, '0')
       else lpad(cast(1 + p_partkey % 97 as string), 2, '0') || lpad(cast(p_size as string), 2, '0') || '1090' end as raw_code,
  case when p_partkey % 11 = 0 then null when p_partkey % 11 = 1 then 'GST 40%' when p_partkey % 11 = 2 then 'GST 0%' when p_partkey % 11 in (3, 4) then '12%'
       when p_partkey % 11 in (5, 6, 7) then 'GST 18%' when p_partkey % 11 = 8 then '0.25%' else 'GST 5%' end as gst_raw,
  upper(p_brand) as brand, case when p_partkey % 3 = 0 then 'Other_Unclassified' else p_type end as category from part""",
    "v_queries": """
select cast(l_orderkey * 10 + l_linenumber as bigint) as row_id,
  case when l_linenumber % 3 = 0 then '  ' || p_name || '  ' || cast(cast(l_quantity as int) as string) || ' ml'
       when l_linenumber % 3 = 1 then upper(p_name) || ' ' || cast(p_size as string) || 'G' else upper(p_name) || ' PKT 2X' || cast(p_size as string) end as query
from lineitem join part on l_partkey = p_partkey""",
    "v_tariff": """
select distinct lpad(cast(1 + p_partkey % 97 as string), 2, '0') || lpad(cast(p_size as string), 2, '0') || '1090' as hsn_code, lower(p_type) || ' ' || p_name as description,
  cast(case when (1 + p_partkey % 97) <= 14 then 5.0 when (1 + p_partkey % 97) <= 40 then 18.0 else 12.0 end as double) as gst_rate, p_type as category
from part where p_partkey % 2 = 0""",
    "v_alias": """
select lower(p_name) as alias, min(lpad(cast(1 + p_partkey % 97 as string), 2, '0') || lpad(cast(p_size as string), 2, '0') || '10') as code from part group by lower(p_name)""",
    "v_search_events": """
select cast(event_id as bigint) as event_id, ts, 'USER TERM ' || cast(user_id % 50 as string) as product_name, event_type as source, cast(floor(value) as int) % 101 as confidence, cast(user_id as bigint) as api_key from events""",
    "v_rate_history": """
select lpad(cast(1 + o_custkey % 97 as string), 2, '0') as chapter, o_orderdate as effective_from,
  lead(o_orderdate) over (partition by 1 + o_custkey % 97 order by o_orderdate, o_orderkey) as effective_to, cast(case o_orderstatus when 'F' then 5.0 when 'O' then 12.0 else 18.0 end as double) as gst_rate from orders""",
    # codes of all shapes, with a rate text and a rate
    "v_codes": """
select cast(p_partkey as bigint) as id, case p_partkey % 9 when 0 then null when 1 then lpad(cast(p_partkey % 97 + 1 as string), 2, '0') when 2 then '99' || lpad(cast(p_size as string), 2, '0') when 3 then '99' || lpad(cast(p_size as string), 2, '0') || '11'
    when 4 then lpad(cast(p_partkey % 97 + 1 as string), 2, '0') || '.' || lpad(cast(p_size as string), 2, '0') when 5 then '190' || cast(p_size as string) when 6 then '99999999'
    when 7 then lpad(cast(p_partkey % 97 + 1 as string), 2, '0') || lpad(cast(p_size as string), 2, '0') || '0000' else lpad(cast(p_partkey % 97 + 1 as string), 2, '0') || lpad(cast(p_size as string), 2, '0') || '109012' end as code,
  case p_partkey % 7 when 0 then 'Nil' when 1 then null when 2 then ' exempt ' when 3 then '18 %' when 4 then 'GST 0.25' when 5 then '-' else '7.5 to 9' end as rate_text,
  case p_partkey % 5 when 0 then null when 1 then 18.0 when 2 then 0.25 when 3 then 4.0 else cast(p_size as double) end as rate, case p_partkey % 6 when 0 then 'sac' when 1 then 'HSN' end as kind,
  case p_partkey % 4 when 0 then '' when 1 then p_type else 'Other_Unclassified' end as category, p_name as name from part""",
    # invoice text with typos, abbreviations, sizes and other scripts
    "v_text": """
select cast(p_partkey as bigint) as id, upper(p_name) || case p_partkey % 13 when 0 then ' COCUNUT REFIL 200ML' when 1 then ' SHP BTL 2X200 ML' when 2 then ' Surf   Excel 1.5 KG PDR' when 3 then ' TAB 10S' when 4 then ' AB1234 * 3X'
    when 5 then ' BTRM CLNR  CLNR 500 GM' when 6 then ' café crème' when 7 then ' SS GLASS, TAB. PET' when 8 then ' (THE) [NEW] #1 PACK + FREE' when 9 then ' TR. MASALA 100 g & 50 G' when 10 then ' vellam podi' when 11 then ' 1905 biscuit 19053100' else ' TATA TEA 12 + 3' end as text from part""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")
NEEDS = {"v_queries": ("lineitem", "part"), "v_search_events": ("events",), "v_rate_history": ("orders",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a given table, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for t in NEEDS.get(name, ("part",)):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])


def with_views(names: tuple[str, ...], body: str) -> str:
    """DuckDB SQL over derived views."""
    used = [n for n in names if n in VIEWS]
    return ("with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in used) + "\n" if used else "") + body
