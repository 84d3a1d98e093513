"""A three-source record view over the synthetic star schema, with a known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Portable SQL, step by step; {part} and {region} are the tables, other names in braces earlier steps.
STEPS = {
    "b": """select p_partkey pk, r_name country, p_brand, p_name, p_type,
        translate(cast(((p_partkey - p_partkey % 20 + p_partkey % 10) * 7919) % 100003 as string), '0123456789', 'aeioubdgmr') wd,
        concat(cast(p_size * 7 + p_partkey % 97 as string), ' ', p_name, ' Street, ', r_name) ad
 from {part} join {region} on r_regionkey = p_partkey % 5""",
    "n": """select pk, country, wd, ad, concat(wd, ' ', p_name, ' ', lower(p_type)) nm, concat(lower(p_type), ' ', p_name, ' ', wd) rv from {b}""",
    "s1": """select concat('S1-', cast(pk as string)) entity_id, country,
  concat(nm, case pk % 4 when 0 then ' Private Limited' when 1 then ' Inc' when 2 then ' SARL' else '' end) business_name,
  ad business_address from {n} where pk % 10 <> 0""",
    "s2": """select concat('S2-', cast(pk as string)) entity_id, country,
  case pk % 6 when 0 then concat(nm, ' Pdivate Limted') when 1 then concat('www.', replace(nm, ' ', ''), '.com')
    when 2 then concat('Acme ', cast(pk as string), ' formerly: ', nm) when 3 then replace(nm, 'o', '0')
    when 4 then concat(rv, ' The') else concat(nm, ' & Co') end business_name,
  case when pk % 29 = 0 then '' when pk % 3 = 0 then concat('000', replace(ad, 'Street', 'St')) else ad end business_address
  from {n} where pk % 17 <> 0""",
    "s3": """select concat('S3-', cast(pk as string)) entity_id, country,
  case pk % 3 when 0 then upper(nm) when 1 then concat('@', replace(nm, ' ', '')) else concat(nm, ' Services') end business_name,
  case when pk % 31 = 0 then 'null' else concat(replace(ad, 'Street', 'Saint'), ' near N Road') end business_address
  from {n} where pk % 17 <> 0 and pk % 2 = 0""",
    "records": "select 1 src, * from {s1} union all select 2, * from {s2} union all select 3, * from {s3}",
}


def records_sql() -> str:
    """The view as one statement over the tables ``part`` and ``region``."""
    named = {n: n for n in ("part", "region", *STEPS)}
    *steps, last = ((n, sql.format(**named)) for n, sql in STEPS.items())
    return "with " + ", ".join(f"{n} as ({sql})" for n, sql in steps) + " " + last[1]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, entity_id, country, business_name, business_address.

    The view is made of a small file that one task reads, while the work on its rows is long: they are dealt to all
    cores, and into as many parts as other tables, so that what is kept of a part is small. Steps are put together without common table expressions, whose numbering would keep equal plans apart."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "region")}
    for name, sql in STEPS.items():
        used = [t for t in tables if f"{{{t}}}" in sql]
        tables[name] = spark.sql(sql, **{t: tables[t] for t in used})
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return tables["records"].repartition(parts, "entity_id")


def truth(records: DataFrame) -> DataFrame:
    """(s1_id, query_id): a record is owned by the entity of its number, where there is one."""
    owner = F.concat(F.lit("S1-"), F.substring("entity_id", 4, 20))
    owned = records.where("src > 1").select(owner.alias("s1_id"), F.col("entity_id").alias("query_id"))
    return owned.join(records.where("src = 1").select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
