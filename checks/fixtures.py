"""A grants table derived from order tables, for tests, checks and the benchmark.

The SQL runs unchanged in Spark and in DuckDB. ``gid`` is the row id and ``truth`` the
customer behind the row, the true entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["orders", "customer", "nation", "region", "part"]

GRANTS_SQL = """
WITH q AS (SELECT *, o_custkey % (SELECT count(*) FROM {part}) AS pk FROM {orders}),
b AS (
 SELECT o.o_orderkey AS gid, o.o_custkey AS ck, o.o_totalprice AS amt, o.o_orderpriority AS prio, o.o_orderdate AS dt,
        n.n_name AS nname, r.r_name AS rname, p.p_name AS pname,
        substr(translate(md5(cast(o.o_custkey AS string)),'0123456789abcdef','bcdfglmnprstaeio'),1,7) AS w1,
        substr(translate(md5(cast(o.o_custkey AS string)),'0123456789abcdef','bcdfglmnprstaeio'),9,5) AS w2
 FROM q o JOIN {customer} c ON o.o_custkey=c.c_custkey JOIN {nation} n ON c.c_nationkey=n.n_nationkey
 JOIN {region} r ON n.n_regionkey=r.r_regionkey JOIN {part} p ON p.p_partkey = o.pk),
e AS (SELECT b.*, CASE ck % 10 WHEN 0 THEN concat('University of ',w1) WHEN 1 THEN concat(w1,' ',w2,' Society')
  WHEN 2 THEN concat(w1,' ',pname,' Inc.') WHEN 3 THEN concat(w1,' ',w2,' Ltée.') WHEN 4 THEN concat('Town of ',w1)
  WHEN 5 THEN concat(w1,' First Nation') WHEN 6 THEN concat(w1,', ',w2) WHEN 7 THEN concat('Canadian ',w1,' Association')
  WHEN 8 THEN concat(CASE ck % 4 WHEN 0 THEN 'Hôpital ' ELSE 'Musée ' END,w1,' ',w2) ELSE concat(w1,' ',w2,' ',CASE ck % 3 WHEN 0 THEN 'radio' ELSE pname END) END AS base FROM b)
SELECT gid,
 concat(CASE WHEN gid % 7=0 THEN ' ' ELSE '' END,'GC-',cast(ck % 40 AS string),'-',cast(gid - gid % 30 AS string),CASE WHEN gid % 11=0 THEN ' ' ELSE '' END) AS ref_number,
 CASE WHEN gid % 97=0 THEN NULL WHEN gid % 8=3 THEN concat(' ',upper(base),'  ') WHEN gid % 8=4 THEN concat(base,' | ',w1,' du ',nname)
      WHEN gid % 8=5 THEN replace(base,'Canadian ','') WHEN gid % 8=6 THEN concat(substr(base,1,length(base)-2),substr(base,length(base),1)) ELSE base END AS recipient_legal_name,
 CASE WHEN gid % 5=0 THEN concat(pname,' ',w2) WHEN gid % 5=1 THEN '' ELSE NULL END AS recipient_operating_name,
 CASE WHEN ck % 10=0 AND gid % 4=0 THEN concat('University of ',w1,'|Université de ',w1) ELSE NULL END AS research_organization_name,
 CASE WHEN gid % 13=0 THEN '999999999' WHEN gid % 13=1 THEN 'N/A' WHEN gid % 13=2 THEN NULL WHEN gid % 13=3 THEN ''
      ELSE concat(lpad(cast((ck+1)*7919 AS string),9,'0'),CASE WHEN gid % 13=4 THEN ' RR0001' WHEN gid % 13=5 THEN 'RT0001' WHEN gid % 13=6 THEN 'rp0001' ELSE '' END) END AS recipient_business_number,
 CASE WHEN gid % 17=0 THEN NULL WHEN gid % 29=0 THEN concat(nname,'|',rname) ELSE concat('city ',cast(ck - ck % 25 AS string)) END AS recipient_city,
 rname AS recipient_province,
 CASE WHEN gid % 31=0 THEN NULL WHEN gid % 23=0 THEN 'US' WHEN gid % 2=0 THEN 'CA' ELSE ' canada ' END AS recipient_country,
 CASE WHEN gid % 19=0 THEN '12345' ELSE concat(substr('ABCEGHJKLMNPRSTVXY',cast(ck % 18 AS int)+1,1),cast(ck % 10 AS string),CASE WHEN gid % 2=0 THEN 'h' ELSE 'H' END,CASE WHEN gid % 3=0 THEN ' ' ELSE '' END,cast(CAST(floor(ck / 10) AS bigint) % 10 AS string),'B',cast(CAST(floor(ck / 100) AS bigint) % 10 AS string)) END AS recipient_postal_code,
 CASE WHEN gid % 3=0 THEN NULL WHEN gid % 101=0 THEN '' ELSE substr('SNFFGAPNNO',cast(ck % 10 AS int)+1,1) END AS recipient_type,
 concat('org-',cast(gid % 25 AS string)) AS owner_org, prio AS prog_name_en,
 CASE WHEN gid % 6=0 THEN cast(110000+ck % 50 AS string) ELSE NULL END AS naics_identifier,
 CASE WHEN gid % 41=0 THEN NULL ELSE amt END AS agreement_value, dt AS agreement_start_date, ck AS truth
FROM e
"""


def grants(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the orders table as grants; a customer's part is found by their number modulo
    the number of parts, whose keys count from 0.
    """
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in BASE_TABLES}
    return spark.sql(GRANTS_SQL, **tables)


def grants_sql() -> str:
    """The same table for an engine that has the base tables as views."""
    return GRANTS_SQL.format(**{t: t for t in BASE_TABLES})
