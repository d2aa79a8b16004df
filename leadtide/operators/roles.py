"""Which column of an unknown table plays which role: scores from names and contents, and the best assignment of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadtide.functions.text import ROLES, column_name, looks_like_date

WHOLE = ("tinyint", "smallint", "int", "bigint")
#: Values that a category may have, and rows a value above which a column groups well.
FEW_VALUES, MANY_ROWS = 50, 8


def name_points(column: str, role: str) -> int:
    """1000 if a word of the role is one of the name's, 800 if the name ends with one, 500 if it holds one of four letters or
    more, else 200; 0 for a price without any such word."""
    name = column_name(column)
    points = 0 if role == "price" else 200
    for word in ROLES[role]:
        if word in name.split("_"):
            return 1000
        points = max(points, 800 if len(word) > 1 and name.endswith(word) else 500 if len(word) > 3 and word in name else 0)
    return points


def facts(df: DataFrame) -> DataFrame:
    """position, column, kind (whole, number, time, text or other), rows, values (distinct, within some per cent), least and
    negative (of numbers), constant, date_share: in one pass without a shuffle of values."""
    parts = []
    for i, f in enumerate(df.schema.fields):
        simple, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        number = simple in WHOLE or simple in ("float", "double") or simple.startswith("decimal")
        kind = "whole" if simple in WHOLE else "number" if number else "time" if simple.startswith(("timestamp", "date")) else "text" if simple in ("string", "boolean") else "other"
        text = c.cast("string") if kind != "other" else F.lit(None).cast("string")
        dates = F.avg(looks_like_date(text).cast("double")) if simple == "string" else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(kind).alias("kind"), F.count(text).alias("rows"), F.approx_count_distinct(text, 0.01).alias("values"), F.coalesce(F.min(text) == F.max(text), F.lit(True)).alias("constant"), (F.coalesce(F.min(c.cast("double") if number else F.lit(None).cast("double")), F.lit(0.0)) < 0).alias("negative"), F.coalesce(dates, F.lit(0.0)).alias("date_share")))
    made = df.agg(*(p.alias(f"_{i}") for i, p in enumerate(parts)))
    return made.select(F.inline(F.array(*(f"_{i}" for i in range(len(parts))))))


def fit_tenths(role: str, named: Column) -> Column:
    """How well a column's contents suit a role, in tenths; ``named``: whether its name is that of an identifier."""
    kind, varied = F.col("kind"), ~F.col("constant")
    numeric = kind.isin("whole", "number") & varied
    if role == "timestamp":
        return F.when(kind == "time", 10).when(F.col("date_share") >= 0.8, 9).otherwise(0)
    if role == "entity_id":
        share = F.when(F.col("values") > 0.9 * F.col("rows"), 3).when(F.col("rows") < MANY_ROWS * F.col("values"), 8).otherwise(10)
        return F.when(kind.isin("whole", "text") & varied & (F.col("date_share") < 0.8), share).otherwise(0)
    if role == "category":
        return F.when(varied & (F.col("values") <= FEW_VALUES), F.when(kind == "text", 10).when(kind == "whole", 5).otherwise(0)).otherwise(0)
    return F.when(numeric & ~named, F.when(~F.col("negative"), 10).otherwise(7 if role == "target" else 0)).otherwise(0)


def role_candidates(df: DataFrame) -> DataFrame:
    """position, column, role, points (0 to 1000) of each column that may play a role.

    Points are those of the name times what the contents are fit for: times or texts that are dates; identifiers that repeat;
    numbers that vary (no prices below 0, no identifiers); texts of at most 50 values. Columns of nulls or one value, and
    all columns of an empty table but times, are candidates for nothing.
    """
    points = [(c, r, name_points(c, r), name_points(c, "entity_id") >= 800) for c in df.columns for r in ROLES if r != "event"]
    names = df.sparkSession.createDataFrame(points, "column string, role string, _name int, _id boolean")
    roles = sorted({r for _, r, _, _ in points})
    rows = facts(df).join(F.broadcast(names), "column")  # a row for each column and role
    fit = F.lit(0)
    for r in roles:
        fit = F.when(F.col("role") == r, fit_tenths(r, F.col("_id"))).otherwise(fit)
    return rows.withColumn("points", F.floor(F.col("_name") * fit / 10).cast("int")).filter("points >= 150").select("position", "column", "role", "points")


def best_assignment(candidates: list[tuple[int, str, int]]) -> dict[str, tuple[int, int]]:
    """By role its (position, points): each role has at most one column and each column at most one role, and the points add
    up to the most. Of equal sums the one whose first role, in order of names, has the leftmost column wins, then the second;
    a role without a column comes last.

    candidates: (position, role, points). A table over sets of roles that grows column by column is exact, in time
    columns x roles x 2 to the number of roles.
    """
    roles = sorted({r for _, r, _ in candidates})
    wide = 2 + max((p for p, _, _ in candidates), default=0)
    place = {r: wide ** (len(roles) - 1 - i) for i, r in enumerate(roles)}
    # A set of roles -> (points, how far left, the choice); a position saves the places that lie right of it.
    best: dict[frozenset, tuple[int, int, tuple]] = {frozenset(): (0, 0, ())}
    for at in sorted({p for p, _, _ in candidates}):
        for taken, (points, left, chosen) in list(best.items()):
            for p, r, more in candidates:
                if p == at and r not in taken:
                    new = (points + more, left + (wide - 1 - p) * place[r], (*chosen, (r, p, more)))
                    if new[:2] > best.get(taken | {r}, (-1, -1))[:2]:
                        best[taken | {r}] = new
    return {r: (p, n) for r, p, n in max(best.values(), key=lambda x: x[:2])[2]}


def suggested_roles(df: DataFrame) -> DataFrame:
    """role, column, points of the best assignment; roles that no column fits are left out. Gathers columns x roles numbers."""
    found = role_candidates(df).collect()
    names = {r.position: r.column for r in found}
    rows = [(role, names[p], n) for role, (p, n) in best_assignment([(r.position, r.role, r.points) for r in found]).items()]
    return df.sparkSession.createDataFrame(rows, "role string, column string, points int")
