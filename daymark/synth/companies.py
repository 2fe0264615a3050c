"""Companies, their employees and their departments.

All three are projections and explodes of the frame they start from: draws come
from hashes of stable keys, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import first_word, mail_address, mail_domain, quoted
from ..functions.draws import date_between, digest, draw, int_between, pick
from . import words

# Distinct names before a suffix is needed.
NAME_COUNT = len(words.SURNAMES) ** 3 * len(words.COMPANY_ENDINGS)
# Shares no factor with NAME_COUNT, so stepping by it visits every name once.
NAME_STEP = 410_099


@dataclass(frozen=True)
class Profile:
    """Header style, integer width and closed value ranges of one flavour of the dataset."""

    camel_case: bool
    integer: str
    employees: tuple[int, int]
    revenue: tuple[int, int]
    salary: tuple[int, int]
    departments: tuple[int, int]
    manager_id: tuple[int, int]
    budget: tuple[int, int]
    department_size: tuple[int, int]

    def header(self, name: str) -> str:
        parts = ["ID" if p == "id" else p.capitalize() for p in name.split("_")]
        if not self.camel_case:
            return "_".join(parts)
        return parts[0].lower() + "".join(parts[1:])

    def named(self, **columns: Column) -> list[Column]:
        return [column.alias(self.header(name)) for name, column in columns.items()]


# The closed ranges of the two styles.
TITLE_CASE = Profile(
    camel_case=False,
    integer="bigint",
    employees=(1, 10_000),
    revenue=(100_000, 1_000_000_000),
    salary=(40_000, 1_500_000),
    departments=(1, 3),
    manager_id=(1, 999_999),
    budget=(10_000, 500_000),
    department_size=(10, 100),
)

CAMEL_CASE = Profile(
    camel_case=True,
    integer="int",
    employees=(0, 249_999),
    revenue=(0, 999_999_999),
    salary=(0, 149_999),
    departments=(1, 5),
    manager_id=(0, 999_998),
    budget=(0, 499_999),
    department_size=(0, 99),
)

# The half-open range of CAMEL_CASE dates, which are text.
CAMEL_DATES = (dt.date(2000, 1, 1), dt.date(2023, 1, 1))


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by))


def company_name(key: Column, seed: int = 0) -> Column:
    """A name that no other key gets, without looking at other rows.

    Keys step through all names before one comes round again; from then on the
    round number is appended.
    """
    place = ((key % NAME_COUNT) * NAME_STEP + seed % NAME_COUNT) % NAME_COUNT
    surnames = len(words.SURNAMES)
    parts = [pick(_div(place, surnames**i), words.SURNAMES) for i in range(3)]
    ending = pick(_div(place, surnames**3), words.COMPANY_ENDINGS)
    cycle = _div(key, NAME_COUNT)
    suffix = F.when(cycle == 0, "").otherwise(F.concat(F.lit("-"), cycle.cast("string")))
    return F.concat(
        parts[0], F.lit(", "), parts[1], F.lit(" and "), parts[2], F.lit(" "), ending, suffix
    )


def industry_phrase(value: Column) -> Column:
    lists = (words.PHRASE_VERBS, words.PHRASE_ADJECTIVES, words.PHRASE_NOUNS)
    sizes = [math.prod(len(w) for w in lists[:i]) for i in range(len(lists))]
    return F.concat_ws(" ", *[pick(_div(value, s), w) for s, w in zip(sizes, lists)])


def companies(
    ids: DataFrame, profile: Profile = TITLE_CASE, seed: int = 0, key: str = "id"
) -> DataFrame:
    """One company per row of ``ids``, e.g. ``spark.range(n)``; ``key`` is unique and not negative."""
    d = digest(seed, "company", F.col(key))
    industry = draw(d, 0)
    return ids.select(
        *profile.named(
            name=company_name(F.col(key).cast("long"), seed),
            industry=pick(industry, words.INDUSTRIES)
            if profile.camel_case
            else industry_phrase(industry),
            employees=int_between(draw(d, 1), *profile.employees).cast(profile.integer),
            revenue=int_between(draw(d, 2), *profile.revenue),
            location=pick(draw(d, 3), words.CITIES),
        )
    )


def fan_out(
    df: DataFrame,
    key: str,
    count: str,
    number: str,
    rows_per_block: int = 10_000,
    rows_per_task: int = 2_000_000,
    tasks: int | None = None,
) -> DataFrame:
    """``count`` rows for each row of ``df``, numbered from 1; none for zero.

    Rows are first expanded into blocks, the blocks dealt out over the tasks, and
    only then expanded in full.  A key with a third of all output is thereby spread
    like any other, and what is shuffled is one small row per block.  The task
    count is explicit because AQE would fold those small rows into one task.
    """
    n = F.col(quoted(count)).cast("long")
    sized = df.where(n > 0)
    if tasks is None:
        total, blocks = (
            sized.agg(F.sum(n), F.sum(F.ceil(n / F.lit(rows_per_block)))).first() or (0, 0)
        )
        cores = df.sparkSession.sparkContext.defaultParallelism
        tasks = max(math.ceil((total or 0) / rows_per_task), min(2 * cores, blocks or 0), 1)
    last = _div(n - 1, rows_per_block)
    start = F.col("_block") * F.lit(rows_per_block)
    return (
        sized.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .repartition(tasks, quoted(key), "_block")
        .withColumn(
            number, F.explode(F.sequence(start + 1, F.least(start + F.lit(rows_per_block), n)))
        )
        .drop("_block")
    )


def employees(
    companies: DataFrame,
    profile: Profile = TITLE_CASE,
    seed: int = 0,
    rows_per_block: int = 10_000,
    tasks: int | None = None,
) -> DataFrame:
    """One row per company and employee number."""
    owner, count = profile.header("name"), profile.header("employees")
    company = F.col(owner)
    # The domain is the company's, so it is worked out once and not per employee.
    domain = F.lower(company) if profile.camel_case else mail_domain(company)
    sized = companies.select(owner, count, domain.alias("_domain"))
    rows = fan_out(sized, owner, count, "_number", rows_per_block, tasks=tasks)
    d = digest(seed, "employee", company, F.col("_number"))
    first, last = pick(draw(d, 0), words.FIRST_NAMES), pick(draw(d, 1), words.SURNAMES)
    return rows.select(
        *profile.named(
            company_name=company,
            first_name=first,
            last_name=last,
            email=mail_address(first, last, F.col("_domain")),
            position=pick(draw(d, 2), words.JOBS),
            salary=int_between(draw(d, 3), *profile.salary).cast(profile.integer),
        )
    )


def departments(
    companies: DataFrame,
    profile: Profile = TITLE_CASE,
    seed: int = 0,
    as_of: dt.date = dt.date(2024, 1, 1),
    ordered_dates: bool = True,
) -> DataFrame:
    """A few departments per company; too few to need dealing out.

    ``TITLE_CASE`` starts between the decade's first day and ``as_of`` and ends within
    five years after.  ``CAMEL_CASE`` draws two days of one range; ``ordered_dates=False``
    leaves them as drawn, so a department may end before it starts.
    """
    company = F.col(profile.header("name"))
    low, high = profile.departments
    count = int_between(draw(digest(seed, "departments", company), 0), low, high)
    rows = companies.select(
        company, F.explode(F.sequence(F.lit(1).cast("long"), count)).alias("_number")
    )
    d, e = (digest(seed, label, company, F.col("_number")) for label in ("department", "terms"))
    if profile.camel_case:
        name = F.concat(F.lit("Department of "), pick(draw(d, 0), words.INDUSTRIES))
        area = pick(draw(e, 3), words.INDUSTRIES)
        drawn = [date_between(draw(e, slot), *CAMEL_DATES) for slot in (0, 1)]
        if ordered_dates:
            drawn = [F.least(*drawn), F.greatest(*drawn)]
        start, end = (F.date_format(day, "yyyy-MM-dd") for day in drawn)
    else:
        name = first_word(pick(draw(d, 0), words.JOBS))
        area = pick(draw(e, 3), words.FUNCTIONAL_AREAS)
        decade = as_of.replace(year=as_of.year - as_of.year % 10, month=1, day=1)
        tomorrow = as_of + dt.timedelta(days=1)
        start = date_between(draw(e, 0), decade, tomorrow)
        end = date_between(draw(e, 1), tomorrow, as_of.replace(year=as_of.year + 5))
    return rows.select(
        *profile.named(
            company_name=company,
            department_name=name,
            manager_id=int_between(draw(d, 1), *profile.manager_id).cast(profile.integer),
            budget=int_between(draw(d, 2), *profile.budget).cast(profile.integer),
            location=pick(draw(d, 3), words.CITIES),
            start_date=start,
            end_date=end,
            department_size=int_between(draw(e, 2), *profile.department_size).cast(
                profile.integer
            ),
            functional_area=area,
        )
    )
