"""Documents rendered from orders: one SQL text that Spark and DuckDB both run.

The facts in a text come from columns, so a query's expected rows are those columns and not a second
extraction. Distractors (a birth date, a two-digit year, an impossible date) stand more than 40
characters from the true date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import TEXTS, spread

MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
NAMES = ["Иванов Иван Иванович", "Петрова Анна Сергеевна", "Сидоров Пётр Олегович", "Кузнецова Мария Ильинична"]
KINDS = ["Договор займа", "Акт сверки", "Исковое заявление", "Постановление"]

_month = "CASE month(d) " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(MONTHS)) + " END"
_name = "CASE custkey % 4 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"
_kind = "CASE orderkey % 4 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(KINDS)) + " END"
_digit = "CAST(substr(s9, {}, 1) AS INT)"
_sum = " + ".join(f"{w} * {_digit.format(i + 1)}" for i, w in enumerate([2, 4, 10, 3, 5, 9, 4, 6, 8]))

#: (doc_id, custkey, kind, person, tax_id, amount, doc_date, style, text)
SQL = f"""
SELECT orderkey AS doc_id, custkey, kind, person, tax_id, amount, CAST(d AS DATE) AS doc_date, style,
       kind || ' № ' || CAST(orderkey AS STRING) || chr(10) ||
       CASE style WHEN 0 THEN 'от ' || dd || '.' || mm || '.' || yyyy
                  WHEN 1 THEN 'от ' || yyyy || '-' || mm || '-' || dd
                  ELSE 'от ' || CAST(day(d) AS STRING) || ' ' || month_name || ' ' || yyyy || ' года' END || chr(10) ||
       'Настоящий документ составлен сторонами в двух экземплярах, по одному для каждой из них.' || chr(10) ||
       'Заявитель: ' || person || ', дата рождения 05.03.1975, зарегистрирован по месту жительства.' || chr(10) ||
       'ИНН ' || tax_id || chr(10) || 'Сумма: ' || CAST(amount AS STRING) || ' руб.' || chr(10) ||
       'Справочно указаны прочие сведения, которые к документу не относятся: 31.02.2020 и 11.12.24' || chr(10) AS text
FROM (SELECT *, lpad(CAST(day(d) AS STRING), 2, '0') AS dd, lpad(CAST(month(d) AS STRING), 2, '0') AS mm,
             CAST(year(d) AS STRING) AS yyyy, {_month} AS month_name,
             s9 || CAST(({_sum}) % 11 % 10 AS STRING) AS tax_id
      FROM (SELECT o_orderkey AS orderkey, o_custkey AS custkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 3 AS style,
                   {_kind.replace("orderkey", "o_orderkey")} AS kind, {_name.replace("custkey", "o_custkey")} AS person,
                   CAST(o_totalprice AS DECIMAL(18, 2)) AS amount,
                   lpad(CAST((o_orderkey * 7919 + o_custkey) % 1000000000 AS STRING), 9, '7') AS s9
            FROM orders) a) b
"""


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), TEXTS)
    return spark.sql(SQL.replace("FROM orders)", "FROM {orders})"), orders=orders)
