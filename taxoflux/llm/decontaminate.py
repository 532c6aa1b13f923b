"""Operator 3: benchmark decontamination by templates.  DataFrame functions only.

Tokens are canonicalised: numbers, names (capitalised inside a sentence) and units (after a number) become typed
placeholders, other words lose case and outer marks.  Windows of WINDOW canonical tokens of items and
documents are hash-joined; matches are gathered by (document, item, offset), so that only windows in line
count together.  A pair whose line covers at least COVERED of the item's windows is checked for slots: what
an item's slot holds must map to one value in the document throughout (John -> Mary everywhere).  So
verbatim copies are found, and so are questions with other names and numbers.

The same is done with wide templates: number words are numbers, names are also those that open a sentence (any
capitalised word but the OPENERS), runs of one placeholder count once, windows are of WIDE tokens, and lines up to
SHIFT tokens apart add up.  A pair found both ways is reported as the first way has it.  Items of which no window has
enough plain tokens are found verbatim only: all their windows, word by word, in one line.

Document windows are never shuffled while the distinct item windows number at most BROADCAST_WINDOWS
(counted first); beyond it both sides are joined by shuffle.  Texts are read again for
candidate pairs only.

Defined cases: null, empty or word-less texts hold nothing; an item with fewer than WINDOW tokens is
one window of its own length; a window needs PLAIN tokens that are no placeholder (or all but one of a shorter
window), so an item of placeholders alone is found verbatim only; repeated rows are judged alike; null doc_ids are
judged like others; empty tables give no rows; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxoflux.llm.runtime import Scratch, unused

WINDOW = 8
PLAIN = 4
WIDE, WIDE_PLAIN, SHIFT = 5, 3, 4
COVERED = 0.5
#: Share of an item's different slot values that may map to more than one value.
INCONSISTENT = 0.25
BROADCAST_WINDOWS = 2_000_000
BROADCAST_ROWS = 500_000  # ids of candidates, some 40 bytes each
# Units that make a placeholder when they follow a number.
UNITS = "kg g mg t lb lbs oz km m cm mm mi mile miles ft feet inch inches l ml litre litres liter liters h hr hrs hour hours min mins minute minutes s sec second seconds day days week weeks month months year years dollar dollars euro euros cent cents percent mph kmh"
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
#: Capitalised words that open sentences and name nothing.
OPENERS = "A After All Also An And Another Are As At Because Before But By Can Did Do Does Each Every Find For From Given Had Has Have He Her Here His How If In Into Is It Its Let Many More Most My No Not Now Of On Only Or Our She Since So Some That The Their Then There These They This Those To Today Under Until Was We Were What When Where Which While Who Whose Why Will With You Your"
SPACE = r"[\x20\x09-\x0D]"
MARKS = r"[.,;:!?\x22“”()\[\]]"
OPEN, TAIL = r"(?<![^\x20\x09-\x0D(\[\x22'“])", r"(?=[)\]\x22'”.,;:!?]*(?:[\x20\x09-\x0D]|$))"


def one_of(words: str) -> str:
    """A pattern for any of the words that shares their beginnings, so that most texts fail it at the first letter."""
    tree: dict = {}
    for word in words.split():
        at = tree
        for letter in word:
            at = at.setdefault(letter, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        parts = [letter + pattern(below) for letter, below in sorted(at.items(), reverse=True)]  # longer words before their beginnings
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return pattern(tree)


def _slots(text: Column, names: str) -> Column:
    """Numbers, units and what ``names`` matches as placeholders.  Patterns begin with what is rare, so that most places fail at once."""
    units = one_of(UNITS)
    x = F.regexp_replace(text, rf"([0-9%]{SPACE})(?i:{units}){TAIL}", "$1\u0002")
    x = F.regexp_replace(x, rf"(?=[+$€£0-9-]){OPEN}[+$€£-]?[0-9][0-9.,:/-]*%?(?i:{units})?{TAIL}", "\u0001")
    x = F.regexp_replace(F.when(text.rlike("[0-9]"), x).otherwise(text), names, "\u0003")
    return F.lower(F.regexp_replace(x, MARKS + "+", ""))


def canonical(text: Column) -> Column:
    """Placeholders for slots, plain words in lower case, no marks.  Tokens keep their order; those made
    of marks alone vanish, as they do in ``tokens``."""
    # a capital after the end of a sentence names nothing
    return _slots(text, rf"\p{{Lu}}(?<=[^.!?\x20\x09-\x0D]{SPACE}[(\[\x22'“]{{0,2}}\p{{Lu}})[\p{{Ll}}\p{{M}}'’-]+{TAIL}")


def wide(text: Column) -> Column:
    """Canonical text with number words and the names that open sentences as slots too."""
    number = one_of(NUMBERS)
    x = F.regexp_replace(text, rf"(^|[\x20\x09-\x0D(\[\x22'“])(?i:{number}(?:-{number})*){TAIL}", "$10")  # group 1, then 0
    return _slots(x, rf"(?=\p{{Lu}}){OPEN}(?!{one_of(OPENERS)}{TAIL})\p{{Lu}}[\p{{Ll}}\p{{M}}'’-]+{TAIL}")


def collapsed(text: Column) -> Column:
    return F.regexp_replace(wide(text), rf"([\x01\x02\x03])(?:{SPACE}+\1(?={SPACE}|$))+", "$1")


def verbatim(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, rf"(?<![^\x20\x09-\x0D]){MARKS}+|{MARKS}+(?={SPACE}|$)", ""))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def plain_tokens(text: Column) -> Column:
    """The tokens as they stand, aligned with those of the canonical text."""
    return F.filter(tokens(text), lambda t: t.rlike(r"[^.,;:!?\x22“”()\[\]]"))


def hashed_windows(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys + __w, the hashes of all ``size`` neighbouring values of __h (__n of them): by doubling, then
    one overlapping step.  Each step is a column of its own, so that none is evaluated twice."""
    have = 1
    df = df.withColumn("__w", F.col("__h"))
    while have < size:
        step = min(have, size - have)
        count = F.greatest(F.col("__n") - (have + step - 1), F.lit(0))
        one, two = F.slice("__w", F.lit(1), count), F.slice("__w", F.lit(step + 1), count)
        df = df.select(*[c for c in df.columns if c != "__w"], F.zip_with(one, two, lambda a, b: F.xxhash64(a, b)).alias("__w"))
        have += step
    return df


def windows(df: DataFrame, keys: list[str], size: int, form=canonical) -> DataFrame:
    """keys, pos (from 0), hash of every window of ``size`` canonical tokens; a null hash for a text without."""
    x = df.select(*keys, tokens(form(F.coalesce("text", F.lit("")))).alias("__t"))
    x = x.select(*keys, F.size("__t").alias("__n"), F.transform("__t", lambda t: F.xxhash64(t)).alias("__h"))
    # the outer form, since for the inner one Spark would evaluate the arrays again, to filter empty ones
    return hashed_windows(x, keys, size).select(*keys, F.posexplode_outer("__w").alias("pos", "hash"))


def item_windows(items: DataFrame, window: int, plain: int, form=canonical) -> DataFrame:
    """item_id, size, ipos, hash, n_windows; windows with enough plain tokens only."""
    base = items.where(F.col("item_id").isNotNull()).select("item_id", tokens(form(F.coalesce("text", F.lit("")))).alias("__t"))
    base = base.withColumns({
        "__n": F.size("__t"),
        "size": F.least(F.size("__t"), F.lit(window)),
        "__h": F.transform("__t", lambda t: F.xxhash64(t)),
        "__m": F.transform("__t", lambda t: F.when(t.rlike("[\u0001\u0002\u0003]"), 0).otherwise(1)),
    }).where("size > 0")
    out = base.where("false").select("item_id", "size", F.lit(0).alias("ipos"), F.lit(0).cast("long").alias("hash"))
    for (size,) in sorted(base.select("size").distinct().collect()):  # at most WINDOW sizes
        rows = hashed_windows(base.where(F.col("size") == size), [], size).select("item_id", "size", "__m", F.posexplode_outer("__w").alias("ipos", "hash"))
        many = F.aggregate(F.slice("__m", F.col("ipos") + 1, F.lit(size)), F.lit(0), lambda a, b: a + b)
        out = out.unionByName(rows.where(F.col("hash").isNotNull() & (many >= min(plain, max(1, size - 1)) if plain else F.col("hash").isNotNull())).select("item_id", "size", "ipos", "hash"))
    totals = out.groupBy("item_id").agg(F.count("*").alias("n_windows"))
    return out.join(totals, "item_id")


def matches(keyed: DataFrame, known: DataFrame, form, broadcast_windows: int):
    """(size, item windows of that size, document windows that are among them) for each size."""
    for (size,) in sorted(known.select("size").distinct().collect()):  # at most WINDOW sizes
        own = known.where(F.col("size") == size)
        distinct = own.select(F.col("hash").alias("known")).distinct()
        if distinct.limit(broadcast_windows + 1).count() <= broadcast_windows:
            distinct = F.broadcast(distinct)
        hits = windows(keyed, ["doc_id", "row_hash"], size, form)
        hits = hits.join(distinct, F.col("hash") == F.col("known"), "left_semi")
        yield size, own, hits.groupBy("doc_id", "row_hash", "pos", "hash").agg(F.lit(1).alias("one")).drop("one")  # repeated rows


def in_line(size: int, own: DataFrame, hits: DataFrame) -> DataFrame:
    lines = hits.join(own, "hash").groupBy("doc_id", "row_hash", "item_id", (F.col("pos") - F.col("ipos")).alias("doc_pos"))
    return lines.agg(F.count_distinct("ipos").alias("n_matched"), F.first("n_windows").alias("n_windows"), F.min("ipos").alias("lo"), (F.max("ipos") + size).alias("hi"))


def bounded(rows: DataFrame, scratch: Scratch, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows, written; sent to all tasks if they are at most ``most``, else joined by shuffle."""
    rows = scratch.save(rows)
    return F.broadcast(rows) if rows.count() <= most else rows


def near_lines(keyed: DataFrame, items: DataFrame, scratch: Scratch, covered: float, inconsistent: float, broadcast_windows: int) -> DataFrame:
    """The pairs that wide templates find, after the slot check."""
    known = scratch.save(item_windows(items, WIDE, WIDE_PLAIN, collapsed))
    found = keyed.sparkSession.createDataFrame([], f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, row_hash long, item_id long, size int, hits array<struct<ipos: int, pos: int>>, n_windows long, n_matched long")
    band = F.floor((F.col("pos") - F.col("ipos")) / SHIFT)
    for size, own, hits in matches(keyed, known, collapsed, broadcast_windows):
        # every two lines at most SHIFT apart are in one band of 2 * SHIFT
        x = hits.join(own, "hash").select("doc_id", "row_hash", "item_id", "n_windows", "ipos", "pos", F.explode(F.array(band, band + 1)).alias("band"))
        x = x.groupBy("doc_id", "row_hash", "item_id", "band").agg(F.collect_set(F.struct("ipos", "pos")).alias("hits"), F.first("n_windows").alias("n_windows"))
        x = x.withColumn("n_matched", F.size(F.array_distinct("hits.ipos")).cast("long")).where(F.col("n_matched") >= covered * F.col("n_windows"))
        found = found.unionByName(x.select("doc_id", "row_hash", "item_id", F.lit(size).alias("size"), "hits", "n_windows", "n_matched"))
    found = scratch.save(found)
    same = (F.col("row_hash") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__d"))

    def words(text, a):
        """Plain tokens, canonical ones, and where each of the collapsed ones starts."""
        c = F.col(f"__{a}c")
        slot = lambda i: F.element_at(c, i + 1).rlike("^[\x01\x02\x03]$")
        kept = F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: (i == 0) | ~slot(i) | (F.element_at(c, i + 1) != F.element_at(c, F.greatest(i, F.lit(1)))))
        return {f"__{a}w": plain_tokens(text), f"__{a}k": F.concat(kept, F.array(F.size(c)))}

    at = bounded(found.select(F.col("doc_id").alias("__d"), F.col("row_hash").alias("__r")).distinct(), scratch)
    texts = keyed.join(at, same, "left_semi").dropDuplicates(["doc_id", "row_hash"]).select(F.col("doc_id").alias("__d"), F.col("row_hash").alias("__r"), "text", tokens(wide(F.col("text"))).alias("__dc"))
    texts = texts.withColumns(words(F.col("text"), "d")).drop("text", "__dc")
    mine = items.groupBy("item_id").agg(F.min("text").alias("text")).where("text is not null").select(F.col("item_id").alias("__i"), "text", tokens(wide(F.col("text"))).alias("__ic")).where(F.size("__ic") > 0)
    mine = mine.withColumns(words(F.col("text"), "i")).drop("text")
    pairs = found.join(texts, same).join(mine, F.col("item_id") == F.col("__i"))
    cells = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda o: F.struct((h["ipos"] + o).alias("i"), (h["pos"] + o).alias("d"))))))
    bare = lambda c: F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+$", "")

    def value(a, j):
        start = F.element_at(f"__{a}k", j + 1)
        return bare(F.array_join(F.slice(f"__{a}w", start + 1, F.element_at(f"__{a}k", j + 2) - start), " "))

    slots = F.filter("__cells", lambda z: F.element_at("__ic", F.element_at("__ik", z["i"] + 1) + 1).rlike("^[\x01\x02\x03]$"))
    pairs = pairs.withColumn("__cells", cells).withColumn("__s", F.transform(slots, lambda z: F.struct(value("i", z["i"]).alias("i"), value("d", z["d"]).alias("d"))))
    values = F.size(F.array_distinct("__s.i"))
    first = F.array_min("hits")
    pairs = pairs.where(F.size(F.array_distinct("__s")) - values <= inconsistent * values)
    return pairs.withColumns({
        "n_slots": F.size("__s"), "n_changed": F.size(F.filter("__s", lambda z: z["i"] != z["d"])),
        "doc_pos": F.element_at("__dk", first["pos"] + 1) - F.element_at("__ik", first["ipos"] + 1),
    })


def contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch, window: int = WINDOW, plain: int = PLAIN, covered: float = COVERED, inconsistent: float = INCONSISTENT, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row a leaked pair: doc_id, row_hash (of id and text), item_id, n_matched, n_windows, doc_pos, n_slots, n_changed."""
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), "text")
    # each text of an item_id is an item of its own; the best of them speaks for the id
    named = items.where(F.col("item_id").isNotNull()).select(F.xxhash64("item_id", "text").alias("key"), F.col("item_id").alias("name"), "text").distinct()
    names, items = scratch.save(named.select("key", "name")), named.select(F.col("key").alias("item_id"), "text")
    known = scratch.save(item_windows(items, window, plain))
    found = spark_empty(docs)
    for size, own, hits in matches(keyed, known, canonical, broadcast_windows):
        found = found.unionByName(in_line(size, own, hits).where(F.col("n_matched") >= covered * F.col("n_windows")))
    # the words of an item without any window are only looked for as they stand
    rest = scratch.save(item_windows(items.join(known.select("item_id").distinct(), "item_id", "left_anti"), window, 0, verbatim))
    for size, own, hits in matches(keyed, rest, verbatim, broadcast_windows):
        found = found.unionByName(in_line(size, own, hits).where(F.col("n_matched") == F.col("n_windows")))
    found = scratch.save(found)
    near = near_lines(keyed, items, scratch, covered, inconsistent, broadcast_windows)
    at = bounded(found.select(F.col("doc_id").alias("__d"), F.col("row_hash").alias("__r")).distinct(), scratch)
    texts = keyed.join(at, (F.col("row_hash") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left_semi")
    doc_words = texts.dropDuplicates(["doc_id", "row_hash"]).select(F.col("doc_id").alias("__d"), F.col("row_hash").alias("__r"), plain_tokens(F.col("text")).alias("__dw"))
    item_words = items.groupBy("item_id").agg(F.min("text").alias("text")).select(F.col("item_id").alias("__i"), plain_tokens(F.coalesce("text", F.lit(""))).alias("__iw"), tokens(canonical(F.coalesce("text", F.lit("")))).alias("__ic"))
    pairs = found.join(doc_words, (F.col("row_hash") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__d"))).join(item_words, F.col("item_id") == F.col("__i"))
    pairs = pairs.withColumns({
        "__dw": F.slice("__dw", F.col("lo") + F.col("doc_pos") + 1, F.col("hi") - F.col("lo")),
        "__iw": F.slice("__iw", F.col("lo") + 1, F.col("hi") - F.col("lo")),
        "__ic": F.slice("__ic", F.col("lo") + 1, F.col("hi") - F.col("lo")),
    })
    bare = lambda c: F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+$", "")
    zipped = F.filter(F.arrays_zip(F.col("__ic").alias("c"), F.col("__iw").alias("i"), F.col("__dw").alias("d")), lambda z: z.getField("c").rlike("[\u0001\u0002\u0003]"))
    pairs = pairs.withColumn("__s", F.transform(zipped, lambda z: F.struct(bare(z.getField("i")).alias("i"), bare(z.getField("d")).alias("d"))))
    values = F.size(F.array_distinct(F.transform("__s", lambda z: z.getField("i"))))
    kinds = F.size(F.array_distinct("__s"))
    pairs = pairs.withColumns({"n_slots": F.size("__s"), "n_changed": F.size(F.filter("__s", lambda z: z.getField("i") != z.getField("d"))), "__odd": kinds - values})
    pairs = pairs.where(F.col("__odd") <= inconsistent * values)
    columns = ["doc_id", "row_hash", "item_id", "n_matched", "n_windows", "doc_pos", "n_slots", "n_changed"]
    pairs = pairs.select(*columns, F.lit(1).alias("__way")).unionByName(near.select(*columns, F.lit(0).alias("__way")))
    best = F.max_by(F.struct("n_matched", "n_windows", "doc_pos", "n_slots", "n_changed"), F.struct("__way", "n_matched", -F.col("doc_pos"))).alias("b")
    pairs = pairs.join(names, F.col("item_id") == F.col("key"))
    return pairs.groupBy("doc_id", "row_hash", "name").agg(best).select("doc_id", "row_hash", F.col("name").alias("item_id"), "b.*")


def spark_empty(docs: DataFrame) -> DataFrame:
    kinds = "row_hash long, item_id long, doc_pos int, n_matched long, n_windows long, lo int, hi int"
    return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kinds}")


def clean(docs: DataFrame, items: DataFrame, scratch: Scratch, **rules) -> DataFrame:
    """The documents, all columns, that hold no item."""
    leak, leak_id = unused(docs, "leak"), unused(docs, "leak_id")
    leaked = bounded(contaminated(docs, items, scratch, **rules).select(F.col("doc_id").alias(leak_id), F.col("row_hash").alias(leak)).distinct(), scratch)
    return docs.join(leaked, (F.xxhash64("doc_id", "text") == F.col(leak)) & docs["doc_id"].eqNullSafe(F.col(leak_id)), "left_anti")
