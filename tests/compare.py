"""Rows of Spark and of DuckDB, brought to one form."""

import datetime
import decimal
import math

DATA = "/root/testdata"


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((repr([plain(r[n]) for n in names]) for r in df.collect()))


def rows_of_duck(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[k] for k in order], sorted(repr([plain(r[k]) for k in order]) for r in found.fetchall())
