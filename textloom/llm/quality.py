"""Quality rules and robust multivariate outliers per language and source; DataFrame functions only.

The robust estimate of a group is the minimum covariance determinant: of all subsets that hold ``share``
of its rows, the one whose covariance has the least determinant. It is searched from several starts
by concentration steps (mean and covariance of the nearest rows, then the nearest rows again), which
never raise the determinant; a start is followed until its determinant no longer falls, and the least
of all is taken. Every step reads the whole table of statistics: rows are not sampled.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import SPACE, runs, shifted, table, unused

#: Features are kept as integers of this fraction, so that sums are exact whatever the order of the rows.
UNIT = 256
#: The transformed statistics and the standard deviation that stands in where one vanishes.
FLOORS = {"length": 0.5, "word": 0.08, "symbols": 0.2, "lines": 0.35, "repeats": 0.35, "stutter": 0.25}
NAMES = list(FLOORS)
PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[: i + 1]]
SALTS = 256
#: Moments of so many groups at most (some 300 bytes each) are broadcast; more are joined by group and salt.
BROADCAST_GROUPS = 20_000


def statistics(docs: DataFrame, window: int = 8) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stutter
    (words equal to the word before) to ``docs``, which has a column text.

    Null text has none of anything. A word is repeated if it is in a run of ``window`` words that is found
    twice or more in the text, the first included; runs are compared by 64-bit hashes, in texts of any length.
    """
    w, bits, ordered, near = unused(docs.columns, "words", "bits", "ordered", "near")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    out = docs.withColumn(w, F.transform(F.array_remove(F.split(text, SPACE), ""), lambda x: F.xxhash64(x)))
    out, run = runs(out, w, window)
    # a hash above its place, as many bits as the place needs: longs sort as primitives
    out = out.withColumn(bits, F.length(F.bin(F.size(run))))
    pack = lambda h, i: shifted("shiftleft", shifted("shiftrightunsigned", h, F.col(bits) + 1), F.col(bits)).bitwiseOR(i.cast("long"))
    high = lambda v: shifted("shiftright", v, F.col(bits))
    place = lambda v: v.bitwiseAND(shifted("shiftleft", F.lit(1).cast("long"), F.col(bits)) - 1).cast("int")
    full = lambda v: F.get(run, place(v))
    out = out.withColumn(ordered, F.sort_array(F.transform(F.col(run), pack)))
    out = out.withColumn(near, F.filter(ordered, lambda v, i: (high(v) == high(F.get(ordered, i - 1))) | (high(v) == high(F.get(ordered, i + 1)))))
    # where runs of different hash agree in the high bits, whole hashes are sorted instead
    mixed = F.size(F.filter(near, lambda v, i: (high(v) == high(F.get(near, i - 1))) & (full(v) != full(F.get(near, i - 1))))) > 0
    same = lambda all_, v, at: F.coalesce(F.get(all_, at)["h"] == v["h"], F.lit(False))
    again = lambda all_: F.filter(all_, lambda v, i: same(all_, v, i - 1) | same(all_, v, i + 1))
    exact = F.transform(let(F.sort_array(F.transform(near, lambda v: F.struct(full(v).alias("h"), place(v).alias("p")))), again), lambda v: v["p"])
    places = F.sort_array(F.when(mixed, exact).otherwise(F.transform(near, place)))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return out.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long").alias("n_stutter"),
    )


def _features() -> list[Column]:
    rate = lambda a, b, k: F.log1p(F.lit(k) * F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)))
    raw = [F.log1p("n_words"), rate("word_chars", "n_words", 1.0), rate("n_symbols", "word_chars", 100.0), rate("n_dup_lines", "n_lines", 10.0), rate("n_repeat_words", "n_words", 10.0), rate("n_stutter", "n_words", 10.0)]
    return [F.round(x * UNIT).cast("long").alias(k) for x, k in zip(raw, NAMES, strict=True)]


def chi2_below(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom < x), by the series of the incomplete gamma function."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= z / (a + n)
        total += term
    return total * math.exp(a * math.log(z) - z - math.lgamma(a))


def chi2_at(p: float, k: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_below(max(mid, 1e-12), k) < p else (lo, mid)
    return lo


def consistent(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal rows is multiplied by to be that of all."""
    d = len(NAMES)
    return share / chi2_below(chi2_at(share, d), d + 2) if share < 1 else 1.0


def _with(rows: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """rows (g, salt, ...) joined with rows for each group: broadcast if they are few, else repeated for every salt, so that no group is in one task."""
    if small:
        return rows.join(F.broadcast(groups), "g")
    return rows.join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["g", "salt"])


def _middle(share: float, x: str) -> str:
    return f"percentile_disc({share}) WITHIN GROUP (ORDER BY {x})"


def _sums(prefix: str = "", of: str = "", when: str = "") -> list[str]:
    """Sums of the features and of their products; ``when``: of the rows for which it is true."""
    value = lambda x: f"coalesce(sum(CASE WHEN {when} THEN {x} END), 0)" if when else f"sum({x})"
    return [f"{value(of + a)} AS {prefix}{a}" for a in NAMES] + [f"{value(f'{of}{a} * {of}{b}')} AS {prefix}{a}_{b}" for a, b in PAIRS]


def _grouped(rows: DataFrame, by: list[str], *sums: str) -> DataFrame:
    return rows.groupBy(*by).agg(*map(F.expr, sums))


def _distances(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, to rows joined with moments: forward substitution with the Cholesky factor."""
    z = [f"({a} - m_{a}{''.join(f' - l_{a}_{b} * z_{b}' for b in NAMES[:i])}) / l_{a}_{a} AS z_{a}" for i, a in enumerate(NAMES)]
    return rows.selectExpr("*", *z, " + ".join(f"z_{a} * z_{a}" for a in NAMES) + " AS d2").drop(*(f"z_{a}" for a in NAMES))


def _factored(moments: DataFrame, floor: float) -> DataFrame:
    """Adds the Cholesky factor l of the covariance c and the logarithm of its determinant; a conditional variance below the floor is the floor's.

    The lower triangles are arrays, row by row, and one fold fills l: a plan of one step, which iterations plan and plan again.
    """
    at = lambda i, j: f"{i} * ({i} + 1) div 2 + {j}"
    places = ", ".join(f"struct({i} AS i, {j} AS j, {(FLOORS[a] * UNIT * floor) ** 2!r}D AS least)" for i, a in enumerate(NAMES) for j in range(i + 1))
    known = f"CASE WHEN p.j = 0 THEN 0D ELSE aggregate(sequence(0, p.j - 1), 0D, (t, k) -> t + get(l, int({at('p.i', 'k')})) * get(l, int({at('p.j', 'k')}))) END"
    rest = f"(get(c, int({at('p.i', 'p.j')})) - {known})"
    entry = f"CASE WHEN p.i = p.j THEN sqrt(greatest({rest}, p.least)) ELSE {rest} / get(l, int({at('p.j', 'p.j')})) END"
    out = moments.selectExpr("*", "array(" + ", ".join(f"c_{a}_{b}" for a, b in PAIRS) + ") AS c")
    out = out.selectExpr("*", f"aggregate(array({places}), cast(array() AS array<double>), (l, p) -> concat(l, array({entry}))) AS l")
    logdet = " + ".join(f"2 * ln(get(l, {i * (i + 3) // 2}))" for i in range(len(NAMES)))
    return out.selectExpr(*moments.columns, *(f"get(l, {k}) AS l_{a}_{b}" for k, (a, b) in enumerate(PAIRS)), f"{logdet} AS logdet")


def _mixed(moments: DataFrame, target: DataFrame | None, whole: int) -> DataFrame:
    """Groups of fewer than ``whole`` rows have a share of the covariance within all groups (``target``: one row), the more the fewer rows."""
    if target is None or whole < 1:
        return moments
    held = [c for c in moments.columns if not c.startswith("c_")]
    mixed = [f"(1 - rho) * c_{a}_{b} + rho * t_{a}_{b} AS c_{a}_{b}" for a, b in PAIRS]
    return moments.crossJoin(F.broadcast(target)).selectExpr("*", f"greatest(0D, 1 - n / {float(whole)}D) AS rho").selectExpr(*held, *mixed)


def _pooled(moments: DataFrame) -> DataFrame:
    """t: the covariance within all groups, from whole numbers for each group, so that their sum is exact, too."""
    return moments.agg(*(F.expr(f"sum(cast(round(c_{a}_{b} * n) AS long)) / sum(n) AS t_{a}_{b}") for a, b in PAIRS))


def _starts(rows: DataFrame, small: bool) -> DataFrame:
    """(g, start, n, m, c) of four starts: around the medians with deviations from them; with the correlation of
    squashed and of spatial-sign scores besides; and the plain mean and covariance."""
    medians = table(_grouped(rows, ["g"], "count(*) AS n", *(f"cast({_middle(0.5, a)} AS double) AS m_{a}" for a in NAMES)), "medians")
    off = _grouped(_with(rows, medians, small), ["g"], *(f"{_middle(0.5, f'abs({a} - m_{a})')} AS s_{a}" for a in NAMES))
    scale = [f"greatest(s_{a} * 1.4826D, {FLOORS[a] * UNIT!r}D) AS s_{a}" for a in NAMES]
    centre = table(medians.join(off, "g").selectExpr("g", "n", *(f"m_{a}" for a in NAMES), *scale), "centres")
    z = [f"({a} - m_{a}) / s_{a} AS z_{a}" for a in NAMES] + ["sqrt(" + " + ".join(f"z_{a} * z_{a}" for a in NAMES) + ") AS norm"]
    # whole numbers, so that sums are exact
    y = [f"cast(round(tanh(z_{a}) * 4096) AS long) AS y_{a}" for a in NAMES] + [f"cast(round(coalesce(try_divide(z_{a}, norm), 0D) * 4096) AS long) AS u_{a}" for a in NAMES]
    scores = _with(rows, centre, small).selectExpr("*", *z).selectExpr("g", *NAMES, *y)
    sums = _grouped(scores, ["g"], *_sums("x_"), *_sums("y_", "y_"), *_sums("u_", "u_")).join(centre, "g")
    spread = lambda k, a, b: f"coalesce(try_divide({k}_{a}_{b}, sqrt(cast({k}_{a}_{a} AS double) * {k}_{b}_{b})), {float(a == b)}D) * s_{a} * s_{b}"
    covariance = [
        lambda a, b: f"s_{a} * s_{b}" if a == b else "0D",
        lambda a, b: spread("y", a, b),
        lambda a, b: spread("u", a, b),
        lambda a, b: f"x_{a}_{b} / n - (x_{a} / n) * (x_{b} / n)",
    ]
    found = [sums.selectExpr("g", f"{k} AS start", "n", *(f"x_{a} / n AS m_{a}" if k == 3 else f"m_{a}" for a in NAMES), *(f"{c(a, b)} AS c_{a}_{b}" for a, b in PAIRS)) for k, c in enumerate(covariance)]
    return reduce(DataFrame.unionByName, found)


#: d2 as one of some 10,000 integers in its order.
_STEP = "floor(ln(1 + least(d2, 1e9D)) * 512) AS step"


def _concentrated(rows: DataFrame, state: DataFrame, share: float, small: bool) -> DataFrame:
    """(g, start, n, before, m, c) of the ``share`` of each group's rows that are nearest by ``state``, whose logdet is before; c is scaled to be that of all normal rows.

    The distance that the share reaches is a step's; of the rows in this step each counts for the part that is missing. Sums are of integers.
    """
    factor = state.selectExpr("g", "start", "n", "logdet AS before", *(f"m_{a}" for a in NAMES), *(f"l_{a}_{b}" for a, b in PAIRS))
    placed = _distances(_with(rows, factor, small)).selectExpr("g", "start", _STEP)
    cuts = _grouped(placed, ["g", "start"], f"{_middle(share, 'step')} AS cut")
    near = _distances(_with(rows, factor.join(cuts, ["g", "start"]), small)).selectExpr("g", "start", "n", "before", "cut", *NAMES, _STEP).where("step <= cut")
    sums = _grouped(near, ["g", "start", "n", "before"], "count_if(step < cut) AS i_k", "count_if(step = cut) AS e_k", *_sums("i_", "", "step < cut"), *_sums("e_", "", "step = cut"))
    sums = sums.selectExpr("*", f"cast(ceil(n * {share}D) AS double) AS h", "least((h - i_k) / e_k, 1D) AS part")
    means = [f"(i_{a} + part * e_{a}) / h AS m_{a}" for a in NAMES]
    return sums.selectExpr("g", "start", "n", "before", *means, *(f"((i_{a}_{b} + part * e_{a}_{b}) / h - m_{a} * m_{b}) * {consistent(share)!r}D AS c_{a}_{b}" for a, b in PAIRS))


def least_determinants(rows: DataFrame, share: float = 0.6, whole: int = 200, floor: float = 1.0) -> tuple[DataFrame, DataFrame, bool]:
    """(moments, target, small): the robust mean m, covariance c, its factor l and logdet of each group g, the
    covariance within all groups, and whether the groups are few. rows: g, salt and the integer features.

    Two steps from each of four starts; the two starts of least determinant go on until its logarithm falls by no
    more than a hundredth. ``whole``: see :func:`judge`; ``floor`` scales the floors of the variances.
    """
    small = rows.select("g").distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    live = table(_factored(_starts(rows, small), floor), "mcd")
    least = lambda some, k: some.withColumn("place", F.expr("row_number() OVER (PARTITION BY g ORDER BY logdet, start)")).where(f"place <= {k}").drop("place")
    target, pool, k = None, [], 0
    while True:
        k += 1
        moved = _concentrated(rows, live, share, small)
        if target is None:
            moved = table(moved, "mcd")
            target = table(_pooled(moved.where("start = 0")), "pooled")
        moved = _factored(_mixed(moved, target, whole), floor)
        moved = table(least(moved, 2) if k == 2 else moved, "mcd")
        falls = (F.col("before") - F.col("logdet") > 1e-2) | F.lit(k == 1)  # a start's own is not of a subset
        done = moved.where(~falls).drop("before")
        pool.append(done)
        if k > 1:  # floors can make a step go up: then the state before is the better one
            pool.append(live.join(done.select("g", "start"), ["g", "start"], "left_semi"))
        live = moved.where(falls).drop("before")
        if live.isEmpty():
            break
    return table(least(reduce(DataFrame.unionByName, pool), 1), "mcd"), target, small


def _reweighted(rows: DataFrame, moments: DataFrame, target: DataFrame, whole: int, small: bool, near: float = 0.975) -> DataFrame:
    """Mean and covariance, factored, of all rows whose distance by ``moments`` has a probability of ``near`` at most."""
    rows = _distances(_with(rows, moments.drop("n"), small)).where(F.col("d2") <= chi2_at(near, len(NAMES)))
    sums = _grouped(rows, ["g"], "count(*) AS k", *_sums("x_")).join(moments.select("g", "n"), "g")
    out = sums.selectExpr("g", "n", *(f"x_{a} / k AS m_{a}" for a in NAMES), *(f"(x_{a}_{b} / k - m_{a} * m_{b}) * {consistent(near)!r}D AS c_{a}_{b}" for a, b in PAIRS))
    return _factored(_mixed(out, target, whole), 1.0)


def _key(docs: DataFrame) -> Column:
    return F.xxhash64(*(x for c in ("doc_id", "text", "lang", "source") for x in (F.col(c), F.col(c).isNull())))


def judge(docs: DataFrame, share: float = 0.6, outlier: float = 1e-6, whole: int = 200, least_words: int = 20, repeats: int = 30) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and key of every row of ``docs``.

    base_failed: fewer than ``least_words`` words, or more than ``repeats`` per cent of them repeated. The other
    rows are judged by the minimum covariance determinant of their language and source (null is a value
    of its own), whose subset holds ``share`` of the rows (:func:`least_determinants`); mean and covariance are
    then taken of all rows near by it (97.5 per cent of a normal group). A row goes if its squared Mahalanobis
    distance has a probability below ``outlier``. Groups of fewer than ``whole`` rows have part of the covariance within all
    groups, larger ones only their own; a variance below its floor counts as the floor's. A group of one or two rows has
    no majority to differ from and is kept. Sums are of integers: the same input gives the same verdicts however
    it is partitioned.

    docs: doc_id, text, lang, source; other columns are not read. Null and empty text has no words and fails; texts may be of any length;
    equal rows have equal verdicts, one row each; an empty table gives an empty result. key is
    the hash of (doc_id, text, lang, source) that :func:`keep` joins on; rows equal in it are equal rows.
    """
    seen = statistics(docs.select("doc_id", "text", "lang", "source"))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeats * F.col("n_words"))
    group = F.xxhash64("lang", F.col("lang").isNull(), "source", F.col("source").isNull())
    key = _key(docs)
    seen = table(seen.select("doc_id", *fields, failed.alias("base_failed"), group.alias("g"), F.pmod(key, F.lit(SALTS)).cast("int").alias("salt"), key.alias("key"), *_features()), "statistics")
    rows = seen.where("not base_failed").select("g", "salt", *NAMES)
    moments, target, small = least_determinants(rows, share, whole)
    final = table(_reweighted(rows, moments, target, whole, small), "mcd-final")
    near = (F.col("n") < 3) | (F.col("d2") <= chi2_at(1 - outlier, len(NAMES)))
    far = _distances(_with(seen.where("not base_failed"), final, small)).select("doc_id", *fields, "base_failed", near.alias("kept"), "key")
    # groups all of whose rows fail have no moments
    bad = seen.where("base_failed").select("doc_id", *fields, "base_failed", F.lit(False).alias("kept"), "key")
    return far.unionByName(bad)


def keep(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their columns, whatever their names; rows whose text is null or empty go, equal rows
    stay or go together, an empty table stays empty."""
    good = judge(docs, **options).where("kept").select("key").distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.withColumn(*reversed((_key(docs), *unused(docs.columns, "key"))))
    return rows.toDF(*names, "key").join(good, "key", "left_semi").select(*(F.col(a).alias(b) for a, b in zip(names, docs.columns, strict=True)))
