"""Benchmark decontamination by template windows, with DataFrame operations only.

A text becomes a template: numbers, names (capitalised words inside a sentence) and units
after numbers turn into typed placeholders that remember their value; the rest is
lower-cased words. Every window of eight template words is hashed, values left out, and
the windows of the documents are hash-joined with those of the benchmark; windows
without a pair of neighbouring words that the benchmark has are not hashed. Which capital is
a name cannot be told for sure, so there are three templates: names as above; no names, all
words lower-cased (exact copies after any word, in any case and with any white space); and
opening capitals of sentences as names too, in windows of which at least half the words are
fixed. Each is judged by itself, and one that passes is enough. The benchmark's
windows are written as a table first, so Spark sees its size and broadcasts it only below
the session's limit; a larger one is joined by a shuffle of hashes.

An item counts as leaked into a document if at least ``COVERAGE`` of its windows occur in
one place of it and the slots are consistent there: wherever windows meet, one value of
the item always stands for the same value in the document. A place is a shift (position
in the document less position in the item), a run of shifts with no gap of more than half
an item (an occurrence with words put in or left out), or the whole document (an item in
scattered parts); one that passes is enough, so copies of an item with different values do
not spoil each other. An item asked again with other numbers or names is caught, a text
that only shares the phrases is not.

Items of fewer than eight words are one window of their own length, and documents are
also cut into windows of just those lengths. Rows: null and empty texts have no windows;
whole texts are read; repeated items and documents give repeated pairs once; documents
and items without an id cannot be named and are left out; rows that repeat a document id
count as one document. An empty benchmark gives an empty result. Other columns are not
read by the search and are kept by the filter.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import stage_table

WINDOW = 8
COVERAGE = 0.3
#: Slots of the gate that windows must pass before they are hashed.
GATE = 1 << 16
#: A window is looked at by the words at a multiple of this.
STRIDE = 5
# Units that follow a number, longest first.
UNITS = (
    "percent", "dollars", "dollar", "euros", "euro", "pounds", "pound", "cents", "cent", "hours", "hour", "minutes", "minute", "seconds",
    "second", "years", "year", "months", "month", "weeks", "week", "days", "day", "meters", "meter", "metres", "metre", "kilometers",
    "kilometres", "miles", "mile", "inches", "inch", "feet", "foot", "grams", "gram", "kilograms", "liters", "litres", "degrees", "degree",
    "mph", "kmh", "kwh", "kg", "mg", "km", "cm", "mm", "ml", "hz", "kb", "mb", "gb", "tb", "lb", "oz", "ft", "g", "m", "l", "s", "h",
)
MARK = "\x01"
NUMBER = "[0-9]+(?:[.,:/][0-9]+)*"
# After a lower-case letter or a comma and a space, a capital starts a name and not a sentence.
NAME = "(?<=[\\p{Ll}0-9,;]\\x20)\\p{Lu}[\\p{L}\\p{M}'-]*"
OPENING = f"(?<![\\p{{L}}\\p{{M}}\\p{{N}}{MARK}'-])\\p{{Lu}}[\\p{{L}}\\p{{M}}]*"
#: Slots of the three templates, by type: as marked, names as words, capitals that open a sentence as names.
TEMPLATES = ("nua", "nu", "nuac")


def template_words(text: Column) -> Column:
    """Words of the text. A placeholder is the mark, its type (n, a, u; c for a capital that opens a sentence) and the value."""
    t = F.regexp_replace(F.regexp_replace(text, f"[\\s\\p{{Z}}{MARK}]+", " "), NAME, f" {MARK}a$0 ")
    t = F.regexp_replace(t, OPENING, f" {MARK}c$0 ")
    # Digits inside a name stay with it: a placeholder's value has no number of its own.
    t = F.regexp_replace(t, f"(?<![\\p{{L}}\\p{{M}}0-9{MARK}]){NUMBER}", f" {MARK}n$0 ")
    t = F.regexp_replace(t, f"(?i)({MARK}n\\S+\\s+)({'|'.join(UNITS)})(?![\\p{{L}}\\p{{M}}0-9])", f"$1{MARK}u$2 ")
    words = F.split(F.lower(t), f"[^\\p{{L}}\\p{{M}}\\p{{N}}{MARK}]+")
    return F.filter(words, lambda w: (w != "") & (w != MARK))


def is_slot(word: Column, types: str = TEMPLATES[-1]) -> Column:
    return F.startswith(word, F.lit(MARK)) & F.substring(word, 2, 1).isin(*types)


def _bound(words: Column, body, gate: bytes | None = None) -> Column:
    """Arrays that ``body`` makes of the words, their marked ones and all hashes in every template, joined to one; each is worked out once."""
    marked = lambda w: F.startswith(w, F.lit(MARK))

    # A marked word's hash in a template: the value's, or that of the slot's type (a capital's is a name's).
    def in_template(x: Column, types: str) -> Column:
        kind = F.substring(x, 2, 1)
        slot = F.xxhash64(F.concat(F.lit(MARK), F.when(kind == "c", "a").otherwise(kind)))
        return F.when(kind.isin(*types), slot).otherwise(F.xxhash64(F.substring(x, 3, 1 << 30)))

    # The gate is bound here too, so that it stands in the plan once.
    def row(w: Column) -> Column:
        slots = F.transform(w, lambda x: F.when(marked(x), x))
        return F.struct(F.lit(bytearray(gate or b"")).alias("gate"), slots.alias("slots"), F.transform(w, lambda x: F.xxhash64(x)).alias("plain"))

    # Only marked words are hashed again, as templates differ in nothing else.
    def templates(d: Column) -> Column:
        hashes = lambda types: F.zip_with(d.plain, d.slots, lambda h, x: F.when(x.isNull(), h).otherwise(in_template(x, types)))
        return F.struct(d.gate.alias("gate"), d.slots.alias("slots"), *[hashes(types).alias(f"t{k}") for k, types in enumerate(TEMPLATES)])

    return F.flatten(F.transform(F.transform(F.transform(F.array(words), row), templates), body))


def _range(first: Column, last: Column, step: int = 1) -> Column:
    return F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _pair(d: Column, k: int, i: Column, alone: bool) -> Column:
    """Hash of a word and the next one in a template, or of a word that is a whole item."""
    return F.xxhash64(F.get(d[f"t{k}"], i), F.lit(0) if alone else F.get(d[f"t{k}"], i + 1))


def word_pairs(words: Column) -> Column:
    """Hashes of all pairs of neighbours in all templates; of the word, if it is alone."""

    def of(d: Column) -> Column:
        n = F.size(d.t0)
        pairs = [F.transform(_range(F.lit(0), n - 2), _pair_of(d, k)) for k in range(3)]
        return F.when(n == 1, F.array(*[_pair(d, k, F.lit(0), True) for k in range(3)])).otherwise(F.concat(*pairs))

    return _bound(words, of)


def _pair_of(d: Column, k: int):
    return lambda i: _pair(d, k, i, False)


def gate_of(pairs: DataFrame) -> bytes:
    """A gate for the hashes ``x`` of ``pairs``: a byte per slot, so its size is fixed whatever the benchmark's is."""
    gate = bytearray(GATE)
    slot = F.pmod("x", F.lit(GATE)).cast("int").alias("slot")
    for r in pairs.select(slot).distinct().collect():  # at most as many as the gate has slots
        gate[r.slot] = 1
    return bytes(gate)


def windows(words: Column, sizes: list[int], gate: bytes | None = None) -> Column:
    """Array of ``(pos, size, h, v)``: windows of the given sizes, hashed without the slots' values, which are ``v``.

    A window has one hash per template; ``v`` holds the marked words at their places and
    null elsewhere. With a ``gate`` only windows that may match are hashed: every window
    holds a pair of neighbours at a multiple of the stride, and that pair must pass. Windows
    that hold the two words after that pair as well are asked for them too.
    """
    several = [s for s in sizes if s > 1]
    # Sizes by stride and whether both pairs are inside for certain.
    long = [s for s in several if s >= STRIDE + 3]
    short = [s for s in several if s < STRIDE + 3]
    groups = [(g, stride, deep) for g, stride, deep in ((short, min(STRIDE, min(short, default=2) - 1), False), (long, STRIDE, True)) if g]

    def cut(d: Column) -> Column:
        n = F.size(d.t0)
        passes = lambda x: F.substring(d.gate, F.pmod(x, F.lit(len(gate))).cast("int") + 1, 1) == F.lit(bytearray(b"\x01"))

        def opened(i: Column, alone: bool = False, deep: bool = False) -> Column:
            at = [i, i + 2] if deep else [i]
            words = [i] if alone else [j for a in at for j in (a, a + 1)]
            found = lambda k: reduce(and_, [passes(_pair(d, k, a, alone)) for a in at])
            # Templates differ only in marked words.
            marked = reduce(or_, [F.get(d.slots, j).isNotNull() for j in words])
            return found(0) | (marked & (found(1) | found(2)))

        def of(size: int, at: Column) -> Column:
            # An array is hashed in one go: a pass over the slice.
            part = lambda i, c: F.slice(d[c], i + 1, size)
            return F.transform(at, lambda i: F.struct(
                i.alias("pos"), F.lit(size).alias("size"), F.array(*[F.xxhash64(part(i, f"t{k}")) for k in range(3)]).alias("h"), part(i, "slots").alias("v"),
            ))

        def of_group(group: list[int], stride: int, deep: bool) -> Column:
            least = min(group)
            starts = _range(F.lit(0), n - least)
            if gate:
                # With both pairs the anchor's four words must be there; a window that holds it has them.
                anchors = F.filter(_range(F.lit(0), n - (4 if deep else 2), stride), lambda i: opened(i, deep=deep))
                starts = F.flatten(F.transform(anchors, lambda p: _range(F.greatest(p - stride + 1, F.lit(0)), F.least(p, n - least))))
            fits = lambda at, s: at if s == least else F.filter(at, lambda i: i <= n - s)
            return F.flatten(F.transform(F.array(starts), lambda at: F.concat(*[of(s, fits(at, s)) for s in group])))

        alone = F.filter(_range(F.lit(0), n - 1), lambda i: opened(i, alone=True)) if gate else _range(F.lit(0), n - 1)
        parts = [of(1, alone)] if 1 in sizes else []
        parts += [of_group(*g) for g in groups]
        return F.concat(*parts)

    return _bound(words, cut, gate)


def _hashes(cut: DataFrame) -> DataFrame:
    """``cut`` with a row per distinct hash of ``w``, as ``h`` and ``mask``."""
    h = [F.get("w.h", F.lit(k)) for k in range(3)]
    bits = lambda k: sum((F.when(h[j] == h[k], 1 << j).otherwise(0) for j in range(3)), F.lit(0))
    each = [F.struct(h[k].alias("h"), bits(k).alias("mask")) for k in range(3)]
    fresh = F.array(each[0], F.when(h[1] != h[0], each[1]), F.when((h[2] != h[0]) & (h[2] != h[1]), each[2]))
    rows = cut.select(*[c for c in cut.columns if c != "w"], "w.pos", "w.size", "w.v", F.explode(F.filter(fresh, lambda x: x.isNotNull())).alias("x"))
    return rows.select("*", "x.h", "x.mask").drop("x")


def _places(met: DataFrame) -> DataFrame:
    """``met`` once per place it belongs to: its shift, its run of near shifts, and the whole document."""
    key = ["doc_id", "item_id", "template"]
    shifts = met.select(*key, "n_words", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    by_shift = Window.partitionBy(*key).orderBy("shift")
    new = F.col("shift") - F.lag("shift").over(by_shift) > F.col("n_words") / 2
    runs = shifts.withColumn("new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("run", F.sum("new").over(by_shift)).select(*key, "shift", "run")
    # Where a pair has one shift only, the three kinds are one.
    runs = runs.withColumn("n_runs", F.max("run").over(Window.partitionBy(*key)) + 1).withColumn("n_shifts", F.count("*").over(Window.partitionBy(*key)))
    kinds = F.array(
        F.struct(F.lit("all").alias("kind"), F.lit(0).cast("long").alias("at")),
        F.when(F.col("n_runs") > 1, F.struct(F.lit("run").alias("kind"), F.col("run").cast("long").alias("at"))),
        F.when(F.col("n_shifts") > 1, F.struct(F.lit("shift").alias("kind"), F.col("shift").cast("long").alias("at"))),
    )
    placed = met.withColumn("shift", F.col("pos") - F.col("item_pos")).join(runs, [*key, "shift"])
    placed = placed.select(*key, "pos", "item_pos", "size", "n_words", "slots", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    return stage_table(placed.select("*", "k.kind", "k.at").drop("k"), "places")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``(doc_id, item_id, n_windows, n_matched, coverage, n_slots)`` of every leaked item."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", template_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = stage_table(items.distinct(), "items")
    length = F.least(F.size("words"), F.lit(window))
    sizes = sorted(r[0] for r in items.select(length.alias("n")).distinct().collect())  # at most ``window`` numbers
    if not sizes:
        sizes = [window]
    own = items.select("item_id", "words", F.explode(windows(F.col("words"), sizes)).alias("w")).where(F.col("w.size") == length)
    own = _hashes(own).withColumnRenamed("pos", "item_pos").withColumn("item_words", F.slice("words", F.col("item_pos") + 1, F.col("size")))
    # A window of capitals says nothing: in the last template at least half the words are fixed.
    fixed = 2 * F.size(F.filter("item_words", lambda w: ~is_slot(w))) >= F.col("size")
    mask = F.when(fixed, F.col("mask")).otherwise(F.col("mask").bitwiseAND(3))
    own = stage_table(own.withColumn("mask", mask).where("mask > 0").select("item_id", "item_pos", "size", "h", "mask", "item_words", F.col("v").alias("item_v"), F.size("words").alias("n_words")), "windows")

    gate = gate_of(items.select(F.explode(word_pairs(F.col("words"))).alias("x")))
    texts = docs.where("doc_id is not null").select("doc_id", template_words(F.col("text")).alias("words"))
    cut = _hashes(texts.select("doc_id", F.explode(windows(F.col("words"), sizes, gate)).alias("w")))
    slots_of = lambda t: F.size(F.filter("item_words", lambda w: is_slot(w, t)))
    slots = F.array(*[slots_of(t) for t in TEMPLATES])
    own_h = own.select("h", "size", "item_id", "item_pos", "n_words", "item_v", F.col("mask").alias("item_mask"), slots.alias("slots"))
    met = cut.join(own_h, ["h", "size"]).withColumn("mask", F.col("mask").bitwiseAND(F.col("item_mask")))
    template = F.explode(F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(1 << k) > 0, F.lit(k)) for k in range(3)]), lambda k: k.isNotNull()))
    # A match has the same slots on both sides, so the values stand side by side. Names and opening capitals are of one kind.
    met = met.select("doc_id", "pos", "size", "item_id", "item_pos", "n_words", "slots", "v", "item_v", template.alias("template"))
    kinds = F.get(F.array(*[F.lit(t) for t in TEMPLATES]), F.col("template"))
    in_slot = lambda w: F.contains(kinds, F.substring(w, 2, 1))
    plain = lambda w: F.regexp_replace(w, f"^{MARK}c", f"{MARK}a")
    values = F.transform(
        F.filter(F.arrays_zip(F.col("item_v").alias("a"), F.col("v").alias("b")), lambda z: in_slot(z.a) & in_slot(z.b)), lambda z: F.struct(plain(z.a).alias("a"), plain(z.b).alias("b"))
    )
    met = stage_table(met.withColumn("slots", F.get("slots", F.col("template"))).withColumn("values", F.array_distinct(values)).drop("v", "item_v").distinct(), "matches")
    places = _places(met)
    keys = ["doc_id", "item_id", "template", "kind", "at"]
    pairs = places.groupBy(*keys).agg(
        F.first(F.col("n_words") - F.col("size") + 1).alias("n_windows"), F.countDistinct("item_pos").alias("n_matched"), F.max("slots").alias("slots")
    )
    pairs = stage_table(pairs.where(F.col("n_matched") >= coverage * F.col("n_windows")), "covered")

    # Slots: whether one value of the item always stands for the same value of the document.
    met_values = met.where(F.size("values") > 0).select("doc_id", "item_id", "template", "pos", "item_pos", F.explode("values").alias("v"))
    met_values = met_values.select("doc_id", "item_id", "template", "pos", "item_pos", "v.a", "v.b")
    values = (
        met_values.join(places.join(pairs.where("slots > 0").select(*keys), keys, "left_semi").select(*keys, "pos", "item_pos"), ["doc_id", "item_id", "template", "pos", "item_pos"])
        .groupBy(*keys, "a").agg(F.count_distinct("b").alias("n"))
        .groupBy(*keys).agg(F.count("*").alias("n_slots"), F.max("n").alias("most"))
    )
    # Of the places that are covered and consistent, the one with the most windows stands for the pair.
    best = F.max(F.struct("n_matched", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), "n_windows")).alias("best")
    found = pairs.drop("slots").join(values, keys, "left").where("most is null or most = 1").groupBy("doc_id", "item_id").agg(best)
    return found.select(
        "doc_id", "item_id", F.col("best.n_windows").cast("long").alias("n_windows"), "best.n_matched",
        (F.col("best.n_matched") / F.col("best.n_windows")).alias("coverage"), "best.n_slots",
    )


def drop_leaked(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold a leaked item."""
    leaked = stage_table(find_leaks(docs, benchmark, **options).select("doc_id").distinct(), "leaked")
    return docs.join(leaked, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
