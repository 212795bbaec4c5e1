"""Rows of a Spark query against rows of DuckDB SQL, whatever their order."""


def plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(str(plain(r[n])) for n in names) for r in df.collect()))


def rows_of_sql(con, sql):
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    names = sorted(columns)
    return names, sorted(tuple(str(plain(r[columns.index(n)])) for n in names) for r in found.fetchall())
