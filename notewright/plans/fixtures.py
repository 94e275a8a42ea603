"""Clinical notes, mentions and boxes made from the tables by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notewright.session import table

BASE = """select l_orderkey as doc, l_linenumber as line, l_partkey as part, l_suppkey as subject, min(l_returnflag) as rf,
 min(l_linestatus) as ls, cast(min(l_quantity) as int) as q, min(l_shipdate) as d from lineitem group by l_orderkey, l_linenumber, l_partkey, l_suppkey"""

NOTE = """concat('DATE: ', day(d), '.', month(d), '.', year(d), chr(10),
 case line % 4 when 0 then 'Final Diagnosis: ' when 1 then 'Diagnosis - ' when 2 then 'Imp: ' else 'Case of ' end,
 lower(p_type), case part % 3 when 0 then ' clear cell carcinoma Stage III' when 1 then ' papillary tumour T2N0M1' else ' mass stage 2b' end,
 case q % 3 when 0 then ' right kidney' when 1 then ' lt kidney' else ' bilateral' end, ' grade ', p_size % 4 + 1, chr(10),
 'HPR: ', p_name, ' Grade ', p_size % 3 + 1, chr(10), 'PET CT: lesion of ', p_size, ' cm', chr(10), 'stable since ', day(d), ' Mar 2021', chr(10),
 'Tab ', p_name, ' ', q, 'mg ', case q % 4 when 0 then 'OD' when 1 then 'BD' when 2 then 'TDS' else 'SOS' end, ' for ', line, ' weeks', chr(10),
 case when q % 5 = 0 then concat('Started Sunitinib ', p_size, ' mg', chr(10)) else '' end,
 'c/o pain in abdomen since ', q, ' days', chr(10), 'PS ', line % 5, ' and KPS ', 50 + line * 5, chr(10),
 case when q % 2 = 0 then 'Right nephrectomy surgery done' else 'SBRT spine 30 gy 5 fr rt' end, chr(10),
 'Serum creat ', p_size % 4, '.', q % 10, chr(10), 'NGS: EGFR exon ', p_size, chr(10), 'PLAN:', chr(10), 'continue ', p_name, chr(10),
 'review after ', line, ' weeks', chr(10), 'Seen by ', p_brand)"""

FORM = """concat('Name: ', p_name, chr(10), 'UHID No: ', doc, '/', line, chr(10), 'Age ', q + 20, ' Sex: ', case when rf = 'A' then 'Male' else 'F' end, chr(10),
 'Date of Admission: ', day(d), '/', month(d), '/', year(d), chr(10), 'Consultant: Dr ', p_brand, chr(10), 'Temp 98.', q % 10, ' F', chr(10),
 'BP ', 100 + q, '/', 60 + line, chr(10), 'SpO2: ', 90 + line, '%', chr(10), 'Resp ', 10 + line, '/min')"""

NOTES_SQL = f"select doc, line, part, subject, q, {NOTE} as note, {FORM} as form from ({BASE}) b join part on p_partkey = part"

MENTIONS_SQL = f"""select subject, (doc * 10 + line) * 1000000 + part as seq, category, case when rf = 'A' then upper(category) else category end as label,
 concat(case when ls = 'O' then 'Item ' else 'ITEM ' end, part % 8) as value, case when q % 5 = 0 then '' else concat('item ', part % 8) end as normalized_value,
 case when q % 4 = 0 then '' else concat(month(d), '.2023') end as date_text, line as page, concat('e', doc % 50) as evidence_id,
 case when q % 3 = 0 then '' else concat('q', q) end as evidence_quote, case rf when 'A' then 'confirmed' when 'R' then 'possible' else 'unknown' end as certainty,
 case when ls = 'O' then 'regex' else 'llm' end as origin
 from (select *, case line % 7 when 0 then 'diagnosis' when 1 then 'medication' when 2 then 'imaging' when 3 then 'lab' when 4 then 'surgery' when 5 then 'follow_up' else 'plan' end as category
 from ({BASE}) b) m"""

BOXES_SQL = f"""select doc, line as page, ((part * 10000 + subject) * 10 + line) as block_id, cast((part % 40) * 20 as double) as top, cast((part % 40) * 20 + 10 + q % 30 as double) as bottom,
 part as reading_order, cast(q * 4 as double) as x0, cast(q * 4 + 60 + part % 200 as double) as x1, 600.0 as width, 800.0 as height,
 concat('block ', part, case part % 9 when 0 then ' signature' when 1 then ' dose table' else '' end) as text from ({BASE}) b"""


def _view(spark: SparkSession, sf_dir: str, names: list[str], sql: str) -> DataFrame:
    return spark.sql(sql.replace("from lineitem", "from {lineitem}").replace("join part ", "join {part} "), **{n: table(spark, sf_dir, n) for n in names})


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ["lineitem", "part"], NOTES_SQL)


def spread_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``notes`` dealt to as many tasks as shuffles have, whatever their bytes: adaptive plans make few partitions of rows
    this narrow, most of all beside larger ones in a union, and each note then takes long. Rows move before their texts
    are made."""
    rows = _view(spark, sf_dir, ["lineitem", "part"], f"select b.*, p_name, p_type, p_size, p_brand from ({BASE}) b join part on p_partkey = part")
    # in another order than they are grouped by: a repartition by what the rows lie by already is left out
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "subject", "part", "line", "doc")
    return spark.sql(f"select doc, line, part, subject, q, {NOTE} as note, {FORM} as form from {{dealt}}", dealt=dealt)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ["lineitem"], MENTIONS_SQL)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ["lineitem"], BOXES_SQL)
