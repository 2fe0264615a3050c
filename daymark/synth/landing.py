"""Generating the dataset and landing it as files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..sinks.files import export, write_by_owner
from .companies import TITLE_CASE, Profile, companies, departments, employees


def land(
    ids: DataFrame,
    root: str,
    profile: Profile = TITLE_CASE,
    file_type: str = "parquet",
    seed: int = 0,
    key: str = "id",
    as_of: dt.date = dt.date(2024, 1, 1),
    load_stamp: str | None = None,
) -> dict[str, str]:
    """Land one company per row of ``ids`` under ``{root}/{entity}``; the paths by entity.

    With a ``load_stamp`` (``yyyyMMdd-HHmmss``) the loads sit side by side, and employees
    and departments get a Parquet folder per company.
    """
    if load_stamp and file_type != "parquet":
        raise ValueError("folders per company are Parquet only")
    paths = {name: f"{root}/{name}" for name in ("companies", "employees", "departments")}
    if load_stamp:
        paths["companies"] += f"/load={load_stamp}"
    owners = companies(ids, profile, seed, key)
    export(owners, paths["companies"], file_type)
    children = {
        "employees": employees(owners, profile, seed),
        "departments": departments(owners, profile, seed, as_of),
    }
    for name, df in children.items():
        if load_stamp:
            owner = profile.header("company_name")
            paths[name] = write_by_owner(df, paths[name], owner, load_stamp)
        else:
            export(df, paths[name], file_type)
    return paths
