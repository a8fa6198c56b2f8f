"""Line dedup by a suffix array over line-id sequences. DataFrame functions only.

Texts become sequences of line ids, one a document, so no run crosses documents. Equal texts are one
sequence, which stands in the array under its first document. Lines that occur at one place alone
cannot be repeated and are left out; what is left is sorted by prefix doubling: the rank of a suffix by
its first 2^(k+1) lines is the order number of the pair (its rank by 2^k lines, the rank of the suffix
2^k lines on), found by a join on the place and a sort by range over all tasks. Suffixes with a pair of
their own share no more lines with any other and leave the array, so a round holds only suffixes that
repeat 2^k lines, and the doubling ends with the longest repeated run.

Suffixes that share their first lines are an interval of the array. From the longest prefix down, each
interval is split by the rank of what follows, which is the binary search for the longest common prefix
in all intervals at once: of the members that also share the next 2^k lines, the first in text order
stays as the first copy of that run and stands in the deeper interval for it, and the others move
there. In the end each suffix has its longest common prefix with any place before it. A suffix whose
run is not the rest of the run of the line before it begins a maximal repeated run. Runs of
``MIN_WORDS`` words or more count, and their later copies are deleted.

No step holds an interval, a document's suffixes or a common line in one task: intervals meet in sums,
and in joins whose keys are places or can be split by the engine.

Defined cases: a null text has no lines and stays null; lines without words take no part: they go
within a deleted run, or where every line with words goes, and stay elsewhere; rows that repeat both
id and text are one document with one result; the order of copies is by id (null first), then text key,
then line; an empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.llm.common import forget, numbered, small_side, staged, text_key, word_count

#: Words in a run, at least, for its later copies to be deleted.
MIN_WORDS = 20
#: White space that makes no word.
BLANKS = " \t\n\x0b\x0c\r"


def line_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, tkey, ord, pos, p, q, words) of the lines with words: their number among these and among all
    lines, 128 bits that stand for the line, and its words."""
    # The key is taken below the explode: beside it, each line would hash its whole text again.
    docs = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), text_key(F.col(text)).alias("tkey"), F.col(text).alias("body"))
    lines = F.transform(F.split("body", "\n"), lambda t, i: F.struct(i.alias("pos"), t.alias("t")))
    worded = F.filter(lines, lambda s: F.btrim(s["t"], F.lit(BLANKS)) != "")
    rows = docs.select("id", "tkey", F.posexplode(worded).alias("ord", "s")).select("id", "tkey", "ord", "s.pos", "s.t")
    return rows.select("id", "tkey", "ord", "pos", F.xxhash64("t").alias("p"), F.xxhash64(F.lit("second"), "t").alias("q"), word_count(F.col("t")).alias("words"))


def equal_texts(lines: DataFrame) -> DataFrame:
    """(tkey, first_null, first, several, words, lo, hi): a text's first id, whether it has others, its words,
    and its first and last line with words."""
    seen = lines.groupBy("tkey").agg(
        F.min("id").alias("least"),
        F.max("id").alias("most"),
        F.max(F.col("id").isNull()).alias("first_null"),
        F.sum("words").alias("words"),
        F.sum((F.col("ord") == 0).cast("long")).alias("n"),
        F.min("pos").alias("lo"),
        F.max("pos").alias("hi"),
    )
    several = F.coalesce((F.col("least") < F.col("most")) | F.col("first_null") & F.col("least").isNotNull(), F.lit(False))
    first = F.when(~F.col("first_null"), F.col("least"))
    return seen.select("tkey", "first_null", first.alias("first"), several.alias("several"), (F.col("words") / F.col("n")).alias("words"), "lo", "hi")


def repeated_lines(lines: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The suffixes that begin with a line found at several places, (doc, ord, g, first, last, w, r) of one line
    each, and (tkey, id, doc) of their documents; ``doc`` and ``g`` number documents and places in text order."""
    place = F.xxhash64("tkey", "ord")
    names = lines.groupBy("p", "q").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("p", "q")
    # Places of equal texts are equal and meet before the shuffle.
    held = lines.join(numbered(names, ["p", "q"], "r"), ["p", "q"]).select("tkey", "ord", "pos", "words", "r").dropDuplicates(["tkey", "ord"])
    held = staged(held, "lines-repeated", like=lines)
    first = texts.join(held.select("tkey").distinct(), "tkey", "left_semi").select("tkey", (~F.col("first_null")).alias("named"), F.col("first").alias("id"))
    docs = staged(numbered(first, ["named", "id", "tkey"], "doc").select("tkey", "id", "doc"), "lines-docs", like=held)
    rows = held.join(docs.select("tkey", "doc"), "tkey").select("doc", "ord", F.col("pos").alias("first"), F.col("pos").alias("last"), F.col("words").alias("w"), "r")
    suffixes = staged(numbered(rows, ["doc", "ord"], "g"), "suffixes-0", like=held)
    forget(held)
    return suffixes, docs


def ranked(suffixes: DataFrame) -> list[tuple[DataFrame, int]]:
    """Prefix doubling: for each k the suffixes whose first 2^k lines are repeated, and how many; with their rank
    ``r`` by these lines, the words ``w`` in them and the place ``last`` of the last of them."""
    levels = [(suffixes, suffixes.count())]
    while levels[-1][1]:
        step, (now, n) = 1 << (len(levels) - 1), levels[-1]
        on = now.select("doc", (F.col("ord") - step).alias("ord"), F.col("last").alias("last2"), F.col("w").alias("w2"), F.col("r").alias("r2"))
        pairs = now.join(on, ["doc", "ord"])
        several = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("r", "r2")
        made = pairs.join(numbered(several, ["r", "r2"], "rank"), ["r", "r2"])
        made = made.select("doc", "ord", "first", F.col("last2").alias("last"), (F.col("w") + F.col("w2")).alias("w"), F.col("rank").alias("r"), "g")
        made = staged(made, f"suffixes-{len(levels)}", n)
        levels.append((made, made.count()))
    return levels


def longest_previous(levels: list[tuple[DataFrame, int]]) -> DataFrame:
    """(doc, ord, first, last, w, ell): of every suffix that has one, its longest common prefix with a place before
    it, as lines ``ell``, words and last place.

    A row stands in the interval (ell, lo): the suffixes that share ``ell`` lines with the suffix ``lo``. A
    ``guest`` stands for the first copy of its interval and is no result.
    """
    state, n_state = None, 0
    for k in range(len(levels) - 1, -1, -1):
        (here, n), (above, n_above) = levels[k], levels[k + 1] if k + 1 < len(levels) else (None, 0)
        if k and not n:
            continue
        new = here.join(above.select("doc", "ord"), ["doc", "ord"], "left_anti") if n_above else here
        new = new.select("doc", "ord", "first", "g", F.lit(0).alias("ell"), F.lit(-1).cast("long").alias("lo"), F.lit(False).alias("guest"), F.col("first").alias("last"), F.lit(0).cast("long").alias("w"))
        rows = new if state is None else state.unionByName(new)
        after = here.select("doc", F.col("ord").alias("at"), F.col("r"), F.col("last").alias("last2"), F.col("w").alias("w2"))
        n_state += n - n_above
        # What is not followed by a repeated run of this length shares it with nothing: a rank of its own.
        met = rows.withColumn("at", F.col("ord") + F.col("ell")).join(after, ["doc", "at"], "left").withColumn("r", F.coalesce("r", -1 - F.col("g")))
        met = staged(met, f"intervals-{k}", n_state)
        # Staged, so that rows of a common interval can be split over tasks where they come back to its head.
        parts = met.where("r >= 0").groupBy("ell", "lo", "r").agg(F.min("g").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        parts = staged(parts, f"heads-{k}", n_state // 2 + 1)
        n_parts = parts.count()
        moved = met.join(small_side(parts, n_parts), ["ell", "lo", "r"], "left")
        stay = F.struct("ell", "lo", "guest", "last", "w")
        deeper = lambda guest: F.struct(
            (F.col("ell") + (1 << k)).alias("ell"), F.col("head").alias("lo"), F.lit(guest).alias("guest"), F.col("last2").alias("last"), (F.col("w") + F.col("w2")).alias("w")
        )
        where = F.when(F.col("head").isNull(), F.array(stay)).when(F.col("head") == F.col("g"), F.array(stay, deeper(True))).otherwise(F.array(deeper(False)))
        state, n_state = moved.select("doc", "ord", "first", "g", F.explode(where).alias("s")).select("doc", "ord", "first", "g", "s.*"), n_state + n_parts
    return state.where("not guest and ell > 0").select("doc", "ord", "first", "last", "w", "ell")


def maximal_runs(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Later copies of maximal repeated runs: (id, tkey, first, last, words) of runs within the first document of
    each text, and (id, tkey, first, last) of documents that repeat a whole text that counts."""
    lines = staged(line_rows(df, key, text), "lines")
    texts = staged(equal_texts(lines), "texts", like=lines)
    suffixes, docs = repeated_lines(lines, texts)
    levels = ranked(suffixes)
    runs = staged(longest_previous(levels).where(F.col("w") >= min_words), "runs", levels[0][1])
    # The run of the line before, if it counts, holds this one unless this one ends later.
    before = runs.select("doc", (F.col("ord") + 1).alias("ord"), F.col("last").alias("held"))
    runs = runs.join(before, ["doc", "ord"], "left").where("held is null or held < last")
    within = runs.join(docs, "doc").select("id", "tkey", "first", "last", F.col("w").alias("words"))
    again = texts.where(F.col("several") & (F.col("words") >= min_words)).select("tkey", F.col("first").alias("own"), F.col("lo").alias("first"), F.col("hi").alias("last"))
    again = staged(again, "texts-again", like=texts)
    whole = lines.where("ord = 0").select("id", "tkey").join(small_side(again, again.count()), "tkey").where(~F.col("id").eqNullSafe(F.col("own"))).select("id", "tkey", "first", "last").distinct()
    return within, whole


def later_copies(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, tkey, gone): the line numbers to delete, in order, of every document that has any."""
    within, whole = maximal_runs(df, key, text, min_words)
    # Runs may overlap; each gives the lines that no run before it in the document gave.
    before = Window.partitionBy("id", "tkey").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = within.withColumn("first", F.greatest("first", F.coalesce(F.max("last").over(before) + 1, "first"))).where("first <= last")
    parts = fresh.groupBy("id", "tkey").agg(F.flatten(F.sort_array(F.collect_list(F.sequence("first", "last")))).alias("gone"))
    return parts.unionByName(whole.select("id", "tkey", F.sequence("first", "last").alias("gone")))


def without(lines: Column, gone: Column) -> Column:
    """``lines`` without the places ``gone`` (sorted): the stretches between them, joined."""
    start = lambda i: F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
    stop = lambda i: F.coalesce(F.get(gone, i), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, start(i) + 1, stop(i) - start(i))))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``df`` with later copies deleted from ``text``, and (n_lines, n_deleted) added.

    A text of which every line with words goes becomes empty.
    """
    gone = later_copies(df, key, text, min_words).select(F.col("id").alias("id__"), F.col("tkey").alias("tkey__"), F.col("gone").alias("gone__"))
    own = text_key(df[text])
    joined = df.join(gone, df[key].eqNullSafe(F.col("id__")) & (own == F.col("tkey__")), "left")
    lines, out = F.split(df[text], "\n"), F.col("gone__")
    left = F.array_join(without(lines, out), "\n")
    cleaned = F.when(out.isNull(), df[text]).otherwise(F.when(left.rlike(r"[^\x20\x09-\x0D]"), left).otherwise(F.lit("")))
    count = lambda c: F.when(c.isNull(), 0).otherwise(F.size(c))
    kept = [cleaned.alias(c) if c == text else df[c] for c in df.columns if c not in ("n_lines", "n_deleted")]
    return joined.select(*kept, count(lines).alias("n_lines"), count(out).alias("n_deleted"))
