"""Persistent threshold crossings with interpolation.

A margin is at least zero where the criterion holds. A crossing is the first place from which it holds for a number of
consecutive rows; interpolation goes to the row before, on a scale that is given by name: log (of the place) or linear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import over


def persistence_flags(df: DataFrame, keys: list[str], at: str, passed: str, persistence: int = 3) -> DataFrame:
    """starts_run: a run of so many passes starts here; ends_run: one ends here."""
    ahead, behind = over(keys, at, f"current row and {persistence - 1} following"), over(keys, at, f"{persistence - 1} preceding and current row")
    hit = f"coalesce(cast(({passed}) as int), 0)"
    return df.withColumns({"starts_run": F.expr(f"min({hit}) {ahead} = 1 and count(*) {ahead} = {persistence}"), "ends_run": F.expr(f"min({hit}) {behind} = 1 and count(*) {behind} = {persistence}")})


def first_persistent(df: DataFrame, keys: list[str], at: str, passed: str, persistence: int = 3) -> DataFrame:
    """crossing: the first place where a persistent run starts, NULL if there is none."""
    return persistence_flags(df, keys, at, passed, persistence).groupBy(*keys).agg(F.min(F.when(F.col("starts_run"), F.col(at))).alias("crossing"))


def interpolated_crossing(df: DataFrame, keys: list[str], at: str, margin: str, ok: str = "true", persistence: int = 3, scale: str = "log", gate_previous: bool = True) -> DataFrame:
    """crossing: like first_persistent, moved to where the margin is zero between the row before and the first of the run.

    A row passes where the margin is known and not negative and ok holds. Without a row before, or where that row is not
    ok (if gate_previous) or has no negative margin, the place itself is the crossing.
    """
    place = over(keys, at)
    f, inverse = ("ln(cast({} as double))", "exp({})") if scale == "log" else ("cast({} as double)", "{}")
    out = df.withColumns({"_m": F.expr(f"cast({margin} as double)"), "_ok": F.expr(f"coalesce({ok}, false)")})
    out = out.withColumns({"_pm": F.expr(f"lag(_m) {place}"), "_pt": F.expr(f"lag({at}) {place}"), "_pok": F.expr(f"lag(_ok) {place}")})
    out = persistence_flags(out, keys, at, "_m >= 0 and _ok", persistence)
    here, before = f.format(at), f.format("_pt")
    between = inverse.format(f"{before} + ({here} - {before}) * (0 - _pm) / (_m - _pm)")
    usable = "_pt is not null and _pm < 0" + (" and _pok" if gate_previous else "")
    value = F.expr(f"case when {usable} then {between} else cast({at} as double) end")
    return out.groupBy(*keys).agg(F.min_by(value, F.when(F.col("starts_run"), F.col(at))).alias("crossing"))


def spectral_margin(ds: str, target: float = 3.0, tolerance: float = 0.03) -> str:
    return f"({tolerance}D - abs({ds} - {target}D))"


def joint_margin(first: str, second: str) -> str:
    """The smaller of two margins, unknown where one is."""
    return f"case when {first} is not null and {second} is not null then least({first}, {second}) end"


def downward_crossing(df: DataFrame, keys: list[str], at: str, value: str, level: float) -> DataFrame:
    """crossing: the first place where the value falls through the level, linearly between its rows."""
    w = over(keys, at)
    out = df.withColumns({"_nv": F.expr(f"lead({value}) {w}"), "_nt": F.expr(f"lead({at}) {w}")}).filter(f"{value} > {level}D and _nv <= {level}D")
    return out.groupBy(*keys).agg(F.min(F.expr(f"{at} + (_nt - {at}) * ({level}D - {value}) / (_nv - {value})")).alias("crossing"))


def first_at_least(df: DataFrame, keys: list[str], at: str, value: str, target: str) -> DataFrame:
    """crossing: the first place where the value reaches the target, linearly from the row before; the place itself if it is the first."""
    w = over(keys, at)
    out = df.withColumns({"_pv": F.expr(f"lag({value}) {w}"), "_pt": F.expr(f"lag({at}) {w}")}).filter(f"{value} >= {target}")
    x = F.expr(f"case when _pt is null or {value} = _pv then cast({at} as double) else _pt + ({at} - _pt) * ({target} - _pv) / ({value} - _pv) end")
    return out.groupBy(*keys).agg(F.min_by(x, F.col(at)).alias("crossing"))


def sign_change(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """crossing: the first place where the value is zero or, linearly, changes sign."""
    w = over(keys, at)
    out = df.withColumns({"_nv": F.expr(f"lead({value}) {w}"), "_nt": F.expr(f"lead({at}) {w}")}).filter(f"{value} = 0 or {value} * _nv < 0")
    x = F.expr(f"case when {value} = 0 then cast({at} as double) else {at} + (_nt - {at}) * (0 - {value}) / (_nv - {value}) end")
    return out.groupBy(*keys).agg(F.min(x).alias("crossing"))


def truncated_crossings(df: DataFrame, keys: list[str], at: str, limits: DataFrame, margin: str, ok: str = "true", persistence: int = 3) -> DataFrame:
    """The interpolated crossing for each upper limit (t_max) of the place; limits are a short list."""
    cut = df.join(F.broadcast(limits), F.col(at) <= F.col("t_max"))
    return interpolated_crossing(cut, ["t_max", *keys], at, margin, ok, persistence)


def latest_start(df: DataFrame, keys: list[str], at: str, persistence: int = 3) -> DataFrame:
    """latest_start: the last place where a run could still start."""
    ahead = over(keys, at, f"current row and {persistence - 1} following")
    return df.withColumn("_n", F.expr(f"count(*) {ahead}")).groupBy(*keys).agg(F.max(F.when(F.col("_n") == persistence, F.col(at))).alias("latest_start"))


def failure_modes(df: DataFrame, keys: list[str], at: str, margin: str, persistence: int = 3) -> DataFrame:
    """mode: crosses, insufficient (too few known margins), never_enters, or not_persistent; with the counts behind it."""
    flagged = persistence_flags(df, keys, at, f"{margin} >= 0", persistence)
    out = flagged.groupBy(*keys).agg(F.count(F.expr(margin)).alias("n_known"), F.sum(F.expr(f"case when {margin} >= 0 then 1 else 0 end")).alias("n_inside"), F.max(F.col("starts_run").cast("int")).alias("_run"))
    mode = F.when(F.col("_run") == 1, "crosses").when(F.col("n_known") < persistence, "insufficient").when(F.col("n_inside") == 0, "never_enters").otherwise("not_persistent")
    return out.select(*keys, "n_known", "n_inside", mode.alias("mode"))


def first_row_where(df: DataFrame, keys: list[str], at: str, condition: str) -> DataFrame:
    """The first row, by place, of each key that meets the condition."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.filter(condition).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(at)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
