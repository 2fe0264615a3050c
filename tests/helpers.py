import datetime as dt


def day(text):
    return dt.date.fromisoformat(text)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df, mode="formatted"):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def files_under(path, suffix):
    from pathlib import Path

    return sorted(str(p) for p in Path(path.removeprefix("file:")).rglob(f"*{suffix}"))
