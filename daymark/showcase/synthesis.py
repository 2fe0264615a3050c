"""The synthetic dataset, keyed by the rows of given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import first_word as first_word_of
from ..functions.columns import mail_address
from ..functions.columns import mail_domain as domain_of
from ..functions.draws import date_between, digest, draw, int_between, pick
from ..operators.names import unique_names as made_unique
from ..session import scratch_dir
from ..sources.files import read_csv
from ..synth import words
from ..synth.companies import (
    CAMEL_CASE,
    NAME_COUNT,
    NAME_STEP,
    TITLE_CASE,
    companies,
    departments,
    employees,
)
from ..synth.landing import land
from .registry import query, table

AS_OF = dt.date(2024, 1, 1)


def _words(values: Sequence[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(value: str, values: Sequence[str]) -> str:
    return f"{_words(values)}[CAST(1 + ({value}) % {len(values)} AS INTEGER)]"


def _draws(label: str, keys: Sequence[str], prefix: str = "d") -> str:
    """Four columns d0 to d3: the eight-digit groups of an MD5 as integers."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    md5 = f"md5(concat_ws('|', '0|{label}', {parts}))"
    return ", ".join(
        f"CAST('0x' || substr({md5}, {1 + 8 * i}, 8) AS BIGINT) AS {prefix}{i}" for i in range(4)
    )


def _between(value: str, bounds: tuple[int, int], kind: str = "BIGINT") -> str:
    low, high = bounds
    return f"CAST({low} + {value} % {high - low + 1} AS {kind})"


def _day(value: str, first: dt.date, end: dt.date) -> str:
    return f"CAST(DATE '{first}' + CAST({value} % {(end - first).days} AS INTEGER) AS DATE)"


_SURNAMES = len(words.SURNAMES)
NAME_SQL = f"""
{_pick("place", words.SURNAMES)} || ', ' || {_pick(f"place // {_SURNAMES}", words.SURNAMES)}
|| ' and ' || {_pick(f"place // {_SURNAMES**2}", words.SURNAMES)}
|| ' ' || {_pick(f"place // {_SURNAMES**3}", words.COMPANY_ENDINGS)}
|| CASE WHEN id < {NAME_COUNT} THEN '' ELSE '-' || CAST(id // {NAME_COUNT} AS VARCHAR) END
"""
VERBS, ADJECTIVES, NOUNS = words.PHRASE_VERBS, words.PHRASE_ADJECTIVES, words.PHRASE_NOUNS
PHRASE_SQL = f"""
{_pick("d0", VERBS)} || ' ' || {_pick(f"d0 // {len(VERBS)}", ADJECTIVES)}
|| ' ' || {_pick(f"d0 // {len(VERBS) * len(ADJECTIVES)}", NOUNS)}
"""


def _title_companies(name: str, key: str) -> str:
    """Companies of every row of a table, with lower-case working names."""
    return f"""
SELECT {NAME_SQL} AS name, {PHRASE_SQL} AS industry,
       {_between("d1", TITLE_CASE.employees)} AS employees,
       {_between("d2", TITLE_CASE.revenue)} AS revenue, {_pick("d3", words.CITIES)} AS location
FROM (SELECT {key} AS id, ({key} % {NAME_COUNT}) * {NAME_STEP} % {NAME_COUNT} AS place,
             {_draws("company", [key])} FROM {name})
"""


def _camel_companies(name: str, key: str) -> str:
    return f"""
SELECT {NAME_SQL} AS name, {_pick("d0", words.INDUSTRIES)} AS industry,
       {_between("d1", CAMEL_CASE.employees, "INTEGER")} AS employees,
       {_between("d2", CAMEL_CASE.revenue)} AS revenue, {_pick("d3", words.CITIES)} AS location
FROM (SELECT {key} AS id, ({key} % {NAME_COUNT}) * {NAME_STEP} % {NAME_COUNT} AS place,
             {_draws("company", [key])} FROM {name})
"""



# Employees come to thousands (TITLE_CASE) or a hundred thousand (CAMEL_CASE) a company, so
# theirs are the companies of smaller tables.
CUSTOMER, SUPPLIER, REGION = (
    ("customer", "c_custkey"),
    ("supplier", "s_suppkey"),
    ("region", "r_regionkey"),
)


def _companies(spark: SparkSession, sf_dir: str, profile, of=CUSTOMER) -> DataFrame:
    name, key = of
    return companies(table(spark, sf_dir, name), profile, key=key)


@query(
    f"""
    SELECT name AS Name, industry AS Industry, employees AS Employees, revenue AS Revenue,
           location AS Location FROM ({_title_companies(*CUSTOMER)})
    """
)
def synth_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _companies(spark, sf_dir, TITLE_CASE)


@query(_camel_companies(*CUSTOMER))
def synth_companies_camel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _companies(spark, sf_dir, CAMEL_CASE)


def _employees_sql(companies_sql: str) -> str:
    numbered = f"""
    SELECT name, unnest(generate_series(1, employees)) AS number FROM ({companies_sql})
    """
    return f"""
    SELECT name, {_pick("d0", words.FIRST_NAMES)} AS first, {_pick("d1", words.SURNAMES)} AS last,
           {_pick("d2", words.JOBS)} AS job, d3
    FROM (SELECT name, {_draws("employee", ["name", "number"])} FROM ({numbered}))
    """


@query(
    f"""
    SELECT name AS Company_Name, first AS First_Name, last AS Last_Name,
           lower(first) || '.' || lower(last) || '@'
           || lower(replace(replace(replace(name, ' ', ''), '.', ''), ',', '')) || '.com' AS Email,
           job AS Position, {_between("d3", TITLE_CASE.salary)} AS Salary
    FROM ({_employees_sql(_title_companies(*SUPPLIER))})
    """
)
def synth_employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employees(_companies(spark, sf_dir, TITLE_CASE, SUPPLIER), TITLE_CASE)


@query(
    f"""
    SELECT name AS "companyName", first AS "firstName", last AS "lastName",
           lower(first || '.' || last || '@' || name) || '.com' AS email,
           job AS position, {_between("d3", CAMEL_CASE.salary, "INTEGER")} AS salary
    FROM ({_employees_sql(_camel_companies(*REGION))})
    """
)
def synth_employees_camel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employees(_companies(spark, sf_dir, CAMEL_CASE, REGION), CAMEL_CASE)


@query(
    f"""
    SELECT name AS "companyName", first AS "firstName", last AS "lastName",
           lower(first || '.' || last || '@' || name) || '.com' AS email,
           job AS position, {_between("d3", CAMEL_CASE.salary, "INTEGER")} AS salary
    FROM ({_employees_sql(_camel_companies(*REGION))})
    """
)
def synth_landed_employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three entities landed as CSV, and the employees read back."""
    ids = table(spark, sf_dir, REGION[0])
    root = scratch_dir(spark, "landing")
    paths = land(ids, root, CAMEL_CASE, "csv", key=REGION[1])
    df = read_csv(spark, paths["employees"])
    return df.withColumn("salary", F.col("salary").cast("int"))


def _departments_sql(companies_sql: str, bounds: tuple[int, int]) -> str:
    counted = f"""
    SELECT name, {_between("d0", bounds)} AS n
    FROM (SELECT name, {_draws("departments", ["name"])} FROM ({companies_sql}))
    """
    numbered = f"SELECT name, unnest(generate_series(1, n)) AS number FROM ({counted})"
    keys = ["name", "number"]
    return f"""
    SELECT name, {_draws("department", keys)}, {_draws("terms", keys, "e")} FROM ({numbered})
    """


TOMORROW = AS_OF + dt.timedelta(days=1)


@query(
    f"""
    SELECT name AS Company_Name, split_part({_pick("d0", words.JOBS)}, ' ', 1) AS Department_Name,
           {_between("d1", TITLE_CASE.manager_id)} AS Manager_ID,
           {_between("d2", TITLE_CASE.budget)} AS Budget, {_pick("d3", words.CITIES)} AS Location,
           {_day("e0", dt.date(2020, 1, 1), TOMORROW)} AS Start_Date,
           {_day("e1", TOMORROW, dt.date(2029, 1, 1))} AS End_Date,
           {_between("e2", TITLE_CASE.department_size)} AS Department_Size,
           {_pick("e3", words.FUNCTIONAL_AREAS)} AS Functional_Area
    FROM ({_departments_sql(_title_companies(*CUSTOMER), TITLE_CASE.departments)})
    """
)
def synth_departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return departments(_companies(spark, sf_dir, TITLE_CASE), TITLE_CASE, as_of=AS_OF)


@query(
    f"""
    SELECT "companyName", "departmentName", "managerID", budget, location,
           strftime(least(a, b), '%Y-%m-%d') AS "startDate",
           strftime(greatest(a, b), '%Y-%m-%d') AS "endDate", "departmentSize", "functionalArea"
    FROM (
      SELECT name AS "companyName",
             'Department of ' || {_pick("d0", words.INDUSTRIES)} AS "departmentName",
             {_between("d1", CAMEL_CASE.manager_id, "INTEGER")} AS "managerID",
             {_between("d2", CAMEL_CASE.budget, "INTEGER")} AS budget,
             {_pick("d3", words.CITIES)} AS location,
             {_day("e0", dt.date(2000, 1, 1), dt.date(2023, 1, 1))} AS a,
             {_day("e1", dt.date(2000, 1, 1), dt.date(2023, 1, 1))} AS b,
             {_between("e2", CAMEL_CASE.department_size, "INTEGER")} AS "departmentSize",
             {_pick("e3", words.INDUSTRIES)} AS "functionalArea"
      FROM ({_departments_sql(_camel_companies(*CUSTOMER), CAMEL_CASE.departments)}))
    """
)
def synth_departments_camel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return departments(_companies(spark, sf_dir, CAMEL_CASE), CAMEL_CASE)


@query(
    """
    SELECT doc_id, source, CASE
             WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 THEN source
             ELSE source || '-' || CAST(doc_id AS VARCHAR) END AS unique_name
    FROM documents
    """
)
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return made_unique(documents, "source", "doc_id")


@query(
    """
    SELECT c_custkey, lower(replace(replace(replace(
             c_name || ', ' || c_mktsegment || ' Inc.', ' ', ''), '.', ''), ',', '')) AS mail_domain
    FROM customer
    """
)
def mail_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    company = F.concat("c_name", F.lit(", "), "c_mktsegment", F.lit(" Inc."))
    customers = table(spark, sf_dir, "customer")
    return customers.select("c_custkey", domain_of(company).alias("mail_domain"))


@query(
    """
    SELECT c_custkey,
           lower(c_mktsegment) || '.' || lower(c_name) || '@' || 'example' || '.com' AS email
    FROM customer
    """
)
def email(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = mail_address(F.col("c_mktsegment"), F.col("c_name"), F.lit("example"))
    return table(spark, sf_dir, "customer").select("c_custkey", address.alias("email"))


@query(
    f"""
    SELECT o_orderkey, {_between("d0", (40_000, 1_500_000))} AS salary
    FROM (SELECT o_orderkey, {_draws("salary", ["o_orderkey"])} FROM orders)
    """
)
def hash_int_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = draw(digest(0, "salary", F.col("o_orderkey")), 0)
    salary = int_between(value, 40_000, 1_500_000).alias("salary")
    return table(spark, sf_dir, "orders").select("o_orderkey", salary)


@query(
    f"""
    SELECT o_orderkey, strftime(day, '%Y-%m-%d') AS start_date, day AS DATE FROM (
      SELECT o_orderkey, {_day("d1", dt.date(2000, 1, 1), dt.date(2023, 1, 1))} AS day
      FROM (SELECT o_orderkey, {_draws("start", ["o_orderkey"])} FROM orders))
    """
)
def hash_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = draw(digest(0, "start", F.col("o_orderkey")), 1)
    day = date_between(value, dt.date(2000, 1, 1), dt.date(2023, 1, 1))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("start_date"), day.alias("DATE")
    )


@query("SELECT doc_id, split_part(text, ' ', 1) AS first_word FROM documents")
def first_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", first_word_of(F.col("text")).alias("first_word"))


@query(
    f"""
    SELECT l_orderkey, l_linenumber, {_pick("d2", words.FUNCTIONAL_AREAS)} AS area
    FROM (SELECT l_orderkey, l_linenumber, {_draws("area", ["l_orderkey", "l_linenumber"])}
          FROM lineitem)
    """
)
def pick_from_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = draw(digest(0, "area", F.col("l_orderkey"), F.col("l_linenumber")), 2)
    area = pick(value, words.FUNCTIONAL_AREAS).alias("area")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", area)
