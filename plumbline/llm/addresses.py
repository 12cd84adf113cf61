"""Same postal address written differently (problem 3).

Lines are cut into slots (house number, unit, city, street name, street type, direction). Nothing about the language is
built in: which words introduce units, which stand before a ZIP code, which are directions and types, and how each is
abbreviated or misspelt, is mined from the lines themselves:

1. Words are told apart by where they stand (a direction stands first or last, a type last or before the direction, a
   unit word before a second number): a word counts if it stands there more often than words of its lines do by chance
   (Z deviations), whatever share of the table it has.
2. Lines that agree in everything else but differ in one token give rewrite pairs: abbreviations of types and
   directions from streets of one city and name, spellings of street names from names of one city that are one edit
   apart. An abbreviation is kept if it meets its long form in more streets than chance allows (Z deviations). A spelling
   is kept if its types and directions are those of the other name and either the other has OUTWEIGH times its houses
   and such an agreement would be a rare chance (at most AGREE of the city's names have them) or the spelling is as rare
   as slips of the pen are (at most SLIPS houses and SLIP_RATE of the other's), or the two share more house numbers than
   chance allows (Poisson tail at most CHANCE).
3. Kept pairs rewrite the lines, and the mining is repeated until no new pair appears.
4. A part that a line leaves out is filled in where the city, street or building leaves only one choice.

Scale: statistics are counted per distinct token, name or street, never over pairs of lines; spellings are found
through names with one letter left out, of which no more names can share one than there are letters and places; the
lexicons (words, cities with their writings, ZIP codes, rewrites) are tables that are joined to the lines, broadcast
only where a count shows that they are small. Only the two-letter words before ZIP codes (at most 26 x 26) come to the
driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.skew import checked_join, salted_join, small
from plumbline.session import cut, cut_counted

#: Standard deviations above chance for a word's place and for an abbreviation.
Z = 3.0
#: Houses that a slip of the pen may have, and the share of the right name's houses on top of that.
SLIPS, SLIP_RATE = 2, 0.02
#: Names of more letters are taken as they are spelt.
LONGEST = 100
#: A rare spelling is outweighed by a name with so many times its houses.
OUTWEIGH = 3
#: Greatest share of the city's street names with the same type and direction for their agreement to count.
AGREE = 0.1
#: Greatest probability of as many shared house numbers by chance.
CHANCE = 0.002
#: Cities up to which their streets' types and directions are sent to all tasks.
CITIES = 1000

_TOKEN = r"(?U)#|,|\d{5}(?:-\d{4})?(?!\w)|\d+(?:st|nd|rd|th)(?!\w)|\d+-?[a-z](?!\w)|\d+|[^\W\d_]+"
_NO_TEXT = "array<string>"


def tokens(line: Column) -> Column:
    """Lower-case words, numbers (with a letter right behind), ordinals, ZIP codes, ``#`` and commas; everything else separates."""
    found = F.regexp_extract_all(F.lower(F.replace(line, F.lit("'"))), F.lit(_TOKEN), F.lit(0))
    return F.transform(F.coalesce(found, F.array().cast(_NO_TEXT)), lambda t: F.when(t.rlike(r"^\d+-[a-z]$"), F.replace(t, F.lit("-"))).otherwise(t))


def is_zip(t: Column) -> Column:
    return t.rlike(r"^\d{5}(-\d{4})?$")


def is_number(t: Column) -> Column:
    return t.rlike(r"^\d+[a-z]?$") & ~is_zip(t)


def squeezed(c: Column) -> Column:
    """Lower case, single blanks; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), F.lit(""))


def shorter(word: Column) -> Column:
    """The word and the word with each one letter left out."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


def one_edit(a: Column, b: Column) -> Column:
    """Whether one letter was added, left out, replaced or swapped with its neighbour (or none)."""
    d = F.levenshtein(a, b)
    swapped = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b
    return (d <= 1) | ((d == 2) & (F.length(a) == F.length(b)) & F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - 1)), swapped))


def _above_chance(seen: str, chance: Column, spread: Column) -> Column:
    return F.col(seen) - chance >= Z * F.sqrt(spread)


def _states(lines: DataFrame) -> list[str]:
    """Two-letter words that stand before ZIP codes in most cases (at most 26 x 26)."""
    pairs = F.explode(F.expr("zip_with(t, concat(slice(t, 2, size(t)), array('')), (a, b) -> struct(a, b))"))
    n = lines.select(pairs.alias("p")).where(F.col("p.a").rlike("^[a-z]{2}$")).groupBy("p.a").agg(F.count(F.lit(1)).alias("n"), F.sum(is_zip(F.col("p.b")).cast("int")).alias("k"))
    return sorted(r["a"] for r in n.where(_above_chance("k", F.col("n") / 2, F.col("n") / 4)).collect())


def _worded(lines: DataFrame) -> DataFrame:
    """``lines``, materialised once, with ``c``: the line's words before numbers, with + in front where the number isn't the first
    and something stands between, else -. Arrays are written as texts, which take a fraction of the space."""
    # words before a number; it counts for a word if the number is not the first and something stands between
    pairs = F.zip_with("t", F.concat(F.slice("t", 2, F.size("t")), F.array(F.lit(""))), lambda w, x: F.struct(w.alias("w"), x.alias("x")))
    before = F.filter(F.transform(pairs, lambda p, i: F.when(is_number(p["x"]), F.struct(p["w"].alias("w"), (i > F.col("first")).alias("late")))), lambda x: x.isNotNull() & x["w"].rlike(r"^[^\d,#]"))
    c = F.array_join(F.transform(F.array_distinct(before), lambda x: F.concat(F.when(x["late"], F.lit("+")).otherwise(F.lit("-")), x["w"])), " ")
    lines = cut(lines.select("key", "own", "id", F.array_join("t", " ").alias("t"), F.when(F.col("first") > 0, c).otherwise("").alias("c")))
    return lines.withColumn("t", F.array_remove(F.split("t", " "), ""))


def _with_units(lines: DataFrame) -> DataFrame:
    """``lines`` with ``u`` in place of ``c``: the words of the line that introduce units; such a word stands before a number that isn't the first in most cases."""
    cand = lines.where("c <> ''").select("id", F.explode(F.split("c", " ")).alias("x")).select("id", F.expr("substring(x, 2)").alias("w"), F.col("x").startswith("+").alias("late"))
    often, n_often = cut_counted(cand.where("late").groupBy("w").agg(F.count(F.lit(1)).alias("k")))
    every = checked_join(lines.select(F.explode(F.array_distinct("t")).alias("w")), often.select("w"), "w", "left_semi", counted=n_often).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    units, n_units = cut_counted(every.join(small(often, n_often), "w").where(_above_chance("k", F.col("n") / 2, F.col("n") / 4)).select("w"))
    got = checked_join(cand, units, "w", "left_semi", counted=n_units).groupBy("id").agg(F.collect_set("w").alias("u"))
    none = F.array().cast(_NO_TEXT)
    some = lines.where("c <> ''").join(got, "id", "left").withColumn("u", F.coalesce("u", none))
    return lines.where("c = ''").withColumn("u", none).unionByName(some).drop("c")


def _read(lines: DataFrame) -> DataFrame:
    """``key, number, unit, zip, own (the record's city), words`` of each line that has a house number other than 0."""
    lines = _worded(lines)
    states = _states(lines)
    lines = _with_units(lines)
    known = frozenset(states)

    def split(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            rows = [(k, own, *got) for k, own, t, u in zip(pdf["key"], pdf["own"], pdf["t"], pdf["u"], strict=True) if (got := _parts(t.tolist(), set(u.tolist()), known))]
            yield pd.DataFrame(rows, columns=["key", "own", "number", "unit", "zip", "words"])

    return lines.select("key", "own", "t", "u").mapInPandas(split, f"key {dict(lines.dtypes)['key']}, own string, number string, unit string, zip string, words array<string>")


_ZIP, _NUMBER = re.compile(r"\d{5}(-\d{4})?\Z"), re.compile(r"\d+[a-z]?\Z")


def _parts(t: list[str], units: set[str], states: frozenset) -> tuple | None:
    """(number, unit, ZIP code, words) of a line's tokens; None if it has no house number, or 0."""
    zips = [bool(_ZIP.match(x)) for x in t]
    number = [bool(_NUMBER.match(x)) and not z for x, z in zip(t, zips, strict=True)]
    unit, left, skip = None, [], -1
    for i, x in enumerate(t):
        if i == skip or x == ",":
            continue
        if i + 1 < len(t) and (((x in units or x == "#") and number[i + 1]) or (x == "#" and len(t[i + 1]) == 1 and t[i + 1].isalpha())):
            unit, skip = t[i + 1].lstrip("0") or "0", i + 1
        elif x != "#":
            left.append(i)
    at = next((i for i in left if number[i]), None)
    if at is None and left and zips[left[0]] and "-" not in t[left[0]] and sum(zips[i] for i in left) > 1:
        at = left[0]  # a house number of five digits, as another ZIP code follows
    house = t[at].lstrip("0") if at is not None else ""
    if not house or not house[0].isdigit():
        return None
    code = [t[i][:5] for i in left if zips[i] and i != at]
    return house, unit, code[-1] if code else None, [t[i] for i in left if i != at and not zips[i] and t[i] not in states]


def _with_city(read: DataFrame) -> DataFrame:
    """``key, number, unit, city, street`` (words): the city is taken from the words that spell it, at either end of the line, else from the ZIP code, else from the record."""
    # the city of a ZIP code: the one that most of its lines' records name
    of_zip = read.where("zip is not null and own is not null").groupBy("zip", "own").agg(F.count(F.lit(1)).alias("n")).groupBy("zip").agg(F.min(F.struct((-F.col("n")).alias("n"), "own")).alias("b")).select("zip", F.col("b.own").alias("known"))
    of_zip, n_zip = cut_counted(of_zip)
    read = cut(checked_join(read, of_zip, "zip", "left", counted=n_zip).withColumn("id", F.monotonically_increasing_id()))
    cities = read.where("own is not null").select("own").distinct().select(F.replace("own", F.lit(" ")).alias("c"), F.col("own").alias("city")).groupBy("c").agg(F.min("city").alias("city"))
    cities, n_cities = cut_counted(cities)
    k = F.size("words")
    ends = F.array(*[F.struct(F.lit(n).alias("k"), F.lit(front).alias("front"), F.when(k > n, F.array_join(F.slice("words", F.lit(1) if front else F.greatest(F.lit(1), k - n + 1), n), "")).alias("w")) for n in (3, 2, 1) for front in (True, False)])
    cand = read.select("id", "known", F.explode(ends).alias("e")).select("id", "known", "e.*").where("w is not null")
    # each distinct writing is looked up once: a city, or one edit from just one city
    writings = cut(cand.select("w").distinct())
    of_city = small(cities.select(F.col("c").alias("w"), "city"), n_cities)
    exact = writings.join(of_city, "w").select("w", F.lit(0).alias("d"), "city")
    rest = writings.join(of_city, "w", "left_anti").where(f"length(w) between 6 and {LONGEST}")
    near_city, n_near = cut_counted(cities.where("length(c) > 5").select("c", "city", F.explode(shorter(F.col("c"))).alias("part")))
    near = checked_join(rest.select("w", F.explode(shorter(F.col("w"))).alias("part")), near_city, "part", counted=n_near).where(one_edit(F.col("w"), F.col("c")))
    near = near.groupBy("w").agg(F.min(F.struct("c", "city")).alias("a"), F.max("c").alias("z")).where("a.c = z").select("w", F.lit(1).alias("d"), "a.city")
    found, n_found = cut_counted(exact.unionByName(near))
    best = checked_join(cand, found, "w", counted=n_found).where("known is null or city = known")
    best = best.groupBy("id").agg(F.min(F.struct("d", "front", (-F.col("k")).alias("k"), "city")).alias("b"))
    d = read.join(best, "id", "left")
    without = lambda front, n: F.when(front, F.slice("words", n + 1, F.greatest(F.lit(0), k - n))).otherwise(F.slice("words", F.lit(1), F.greatest(F.lit(0), k - n)))
    # badly misspelt: what the ZIP code says is left out where words come close to it, one by one
    spelt = F.split("known", " ")
    size = F.size(spelt)
    close = lambda at: (k > size) & F.forall(F.zip_with(F.slice("words", at, size), spelt, lambda a, b: F.coalesce(one_edit(a, b), F.lit(False))), lambda x: x)
    street = F.when(F.col("b").isNotNull(), without(F.col("b.front"), -F.col("b.k")))
    street = street.when(F.col("known").isNull(), F.col("words")).when(close(F.greatest(F.lit(1), k - size + 1)), without(F.lit(False), size)).when(close(F.lit(1)), without(F.lit(True), size)).otherwise(F.col("words"))
    return d.select("key", "number", "unit", F.coalesce("b.city", "known", "own").alias("city"), street.alias("street"))


def _word_classes(parsed: DataFrame) -> DataFrame:
    """``w, class``: directions (``d``) and types (``t``), by where words stand in streets of three words or more (two for types)."""
    s = parsed.where(F.size("street") > 1)
    at = F.posexplode("street").alias("i", "w")
    one = s.select(F.size("street").alias("k"), at).withColumn("p", 1 / F.col("k"))
    sure = F.col("k") > 2
    w = one.groupBy("w").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("i") == 0).cast("int")).alias("first"), F.sum((F.col("i") == F.col("k") - 1).cast("int")).alias("last"), F.sum(((F.col("i") == F.col("k") - 2) & (F.col("i") > 0)).cast("int")).alias("before_last"),
        F.sum(F.when(sure & ((F.col("i") == 0) | (F.col("i") == F.col("k") - 1)), 1).otherwise(0)).alias("outer"), F.sum(F.when(sure, 2 * F.col("p"))).alias("eo"), F.sum(F.when(sure, 2 * F.col("p") * (1 - 2 * F.col("p")))).alias("vo"), F.sum("p").alias("el"), F.sum(F.col("p") * (1 - F.col("p"))).alias("vl"),
    )
    d = (F.col("first") >= 0.3 * F.col("n")) & (F.col("last") >= 0.03 * F.col("n")) & (F.col("first") + F.col("last") >= 0.85 * F.col("n")) & _above_chance("outer", F.col("eo"), F.col("vo"))
    t = (F.col("last") >= 0.5 * F.col("n")) & (F.col("last") + F.col("before_last") >= 0.85 * F.col("n")) & _above_chance("last", F.col("el"), F.col("vl"))
    return w.select("w", F.when(d, "d").when(t, "t").alias("class")).where("class is not null")


def _slots(parsed: DataFrame, classes: DataFrame, n_classes: int) -> DataFrame:
    """``dir, type, name`` of each line's street; the name is written together, so lost blanks don't matter."""
    one = parsed
    # the class of the first word and of the last two: what else a street has in it belongs to the name
    for name, i in (("c1", 1), ("c8", -2), ("c9", -1)):
        word = F.when(F.size("street") >= abs(i), F.element_at("street", i))
        one = checked_join(one.withColumn("w", word), classes.withColumnRenamed("class", name), "w", "left", counted=n_classes).drop("w")
    many = F.size("street") > 1
    lead = many & F.coalesce(F.col("c1") == "d", F.lit(False))
    tail = many & ~lead & F.coalesce(F.col("c9") == "d", F.lit(False))
    one = one.withColumns({"dir": F.when(lead, F.element_at("street", 1)).when(tail, F.element_at("street", -1)), "ct": F.when(tail, F.col("c8")).otherwise(F.col("c9"))})
    one = one.withColumn("street", F.when(lead, F.slice("street", 2, F.size("street"))).when(tail, F.slice("street", 1, F.greatest(F.lit(0), F.size("street") - 1))).otherwise(F.col("street")))
    typed = (F.size("street") > 1) & F.coalesce(F.col("ct") == "t", F.lit(False))
    one = one.withColumn("type", F.when(typed, F.element_at("street", -1)))
    one = one.withColumn("name", F.array_join(F.when(typed, F.slice("street", 1, F.greatest(F.lit(0), F.size("street") - 1))).otherwise(F.col("street")), ""))
    return one.select("key", "number", "unit", "city", "name", "type", "dir").where("name <> ''")


def _abbreviations(streets: DataFrame) -> tuple[DataFrame, int]:
    """``slot, short, long``, and how many: rewrites of types and of directions, tokens that abbreviate another and stand with it in streets
    of one city and name twice or more and Z deviations more often than chance would have it. A long form that is a short
    form itself gives way to its own long form.

    Per city and name the slot's tokens (few) are paired with themselves, with what they abbreviate, and with nothing,
    which counts tokens, pairs and streets at once; everything after that is as large as the tokens are many.
    """
    slots = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("t")) for s in ("type", "dir")])).alias("x")
    seen = streets.select("city", "name", slots).where("x.t is not null").groupBy("city", "name", "x.slot").agg(F.array_union(F.collect_set("x.t"), F.array(F.lit(""))).alias("ts"))
    pairs = "flatten(transform(ts, s -> transform(filter(ts, l -> l = s or (s <> '' and length(s) < length(l) and l rlike concat('^', array_join(split(s, ''), '.*')))), l -> struct(s as s, l as l))))"
    n, n_pairs = cut_counted(seen.select("slot", F.explode(F.expr(pairs)).alias("p")).groupBy("slot", F.col("p.s").alias("short"), F.col("p.l").alias("long")).agg(F.count(F.lit(1)).alias("k")))
    own = n.where("short = long")
    total = own.where("short = ''").select("slot", F.col("k").alias("total"))
    one, other = small(own.select("slot", "short", F.col("k").alias("one")), n_pairs), small(own.select("slot", "long", F.col("k").alias("other")), n_pairs)
    # two slots have two totals
    both = n.where("short <> long").join(one, ["slot", "short"]).join(other, ["slot", "long"]).join(F.broadcast(total), "slot")
    chance = F.col("one") * F.col("other") / F.col("total")
    # the spread of a hypergeometric distribution: streets with both tokens, given how many have each
    spread = chance * (F.col("total") - F.col("one")) * (F.col("total") - F.col("other")) / (F.col("total") * F.greatest(F.lit(1), F.col("total") - 1))
    kept = both.where("k >= 2").where(_above_chance("k", chance, spread))
    best, n_best = cut_counted(kept.groupBy("slot", "short").agg(F.max(F.struct(F.length("long").alias("n"), "k", "long")).alias("b")).select("slot", "short", F.col("b.long").alias("long")))
    if n_best:
        again = small(best.select("slot", F.col("short").alias("long"), F.col("long").alias("longer")), n_best)
        best = cut(best.join(again, ["slot", "long"], "left").select("slot", "short", F.coalesce("longer", "long").alias("long")))
    return best, n_best


def _rewritten(df: DataFrame, rewrites: DataFrame, n: int) -> DataFrame:
    """``df`` with types and directions rewritten; ``n``: the number of rewrites."""
    for slot in ("type", "dir") if n else ():
        r = rewrites.where(F.col("slot") == slot).select(F.col("short").alias(slot), F.col("long").alias("__better"))
        df = checked_join(df, r, slot, "left", counted=n).withColumn(slot, F.coalesce("__better", slot)).drop("__better")
    return df


def _spellings(streets: DataFrame, houses: DataFrame, room: DataFrame, n_cities: int) -> tuple[DataFrame, int]:
    """``city, name, better``, and how many at most (0: none): spellings to replace, found among names of one city that are
    one edit apart. ``houses``: distinct ``city, name0, number``; ``room``: each city's different numbers."""
    agree = F.collect_set(F.when(F.col("type").isNotNull(), F.struct("type", F.coalesce("dir", F.lit("")).alias("dir"))))
    names = streets.where(f"length(name) between 4 and {LONGEST}").groupBy("city", "name").agg(F.sum("n").alias("n"), agree.alias("ways"))
    names = cut(names)
    parts = names.select("city", "name", "n", "ways", F.explode(shorter(F.col("name"))).alias("part"))
    mine = parts.withColumnRenamed("ways", "mine")
    other = parts.select("city", "part", F.col("name").alias("better"), F.col("n").alias("m"), "ways")
    # names that share a part differ in one letter of an alphabet at one place: they are few, however many lines they have
    pairs = mine.join(other, ["city", "part"]).where("m > n or (m = n and better < name)").where(F.levenshtein("name", "better") <= 2)
    # a line that leaves its direction out goes with any
    same = F.forall("mine", lambda a: F.exists("ways", lambda b: (a["type"] == b["type"]) & ((a["dir"] == "") | (b["dir"] == "") | (a["dir"] == b["dir"]))))
    pairs = pairs.where(same | (F.size("ways") == 0)).select("city", "name", "n", "better", "m", "mine").distinct()
    # how likely it is that another street of the city would agree in type and direction: a city's names are counted by
    # type and direction (few), and all of them under null
    each = names.select("city", F.explode(F.concat("ways", F.array(F.lit(None).cast("struct<type:string,dir:string>")))).alias("way"))
    counts = each.groupBy("city", "way").agg(F.count(F.lit(1)).alias("k"))
    share = counts.groupBy("city").agg(F.max(F.when(F.col("way").isNull(), F.col("k"))).alias("all"), F.map_from_entries(F.collect_list(F.when(F.col("way").isNotNull(), F.struct("way", "k")))).alias("with"))
    q = F.array_min(F.transform("mine", lambda w: F.element_at("with", w) / F.col("all")))
    pairs = pairs.join(small(share, n_cities, CITIES), "city").select("city", "name", "n", "better", "m", F.coalesce(q, F.lit(1.0)).alias("q"))
    slip = (F.col("m") >= OUTWEIGH * F.col("n")) & ((F.col("q") <= AGREE) | (F.col("n") <= SLIPS + SLIP_RATE * F.col("m")))
    pairs, _, n_doubtful = cut_counted(pairs.withColumn("slip", slip), ~F.col("slip"))
    every = pairs.where("slip").select("city", "name", "better", "m")
    if n_doubtful:
        doubtful = pairs.where("not slip")
        # either name's houses; a number that both have is shared
        sides = doubtful.select("city", F.col("name").alias("of"), "better", "m", F.explode(F.array(F.struct(F.col("name").alias("name"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col("better").alias("name"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("x")).select("city", "of", "better", "m", "x.*")
        now = streets.select("city", "name0", "name").join(small(sides, 2 * n_doubtful), ["city", "name"]).select("city", "name0", "of", "better", "m", "a", "b").distinct()
        at = houses.join(now, ["city", "name0"]).groupBy("city", "of", "better", "m", "number").agg(F.max("a").alias("a"), F.max("b").alias("b"))
        shared = at.groupBy("city", "of", "better", "m").agg(F.sum("a").alias("size"), F.sum("b").alias("size2"), F.sum(F.col("a") * F.col("b")).alias("k")).where("k > 0")
        shared = shared.join(small(room, n_cities), "city").withColumnRenamed("of", "name")
        e = F.col("size") * F.col("size2") / F.col("room")
        # the tail of a Poisson distribution is at most (e / k)^k exp(k - e) above its mean
        tail = F.when(F.col("k") > e, F.exp(F.col("k") * F.log(e / F.col("k")) + F.col("k") - e)).otherwise(1.0)
        every = every.unionByName(shared.where(tail <= CHANCE).select("city", "name", "better", "m"))
    one = every.groupBy("city", "name").agg(F.max(F.struct("m", "better")).alias("x")).select("city", "name", F.col("x.better").alias("better"))
    one, n_one = cut_counted(one)
    # a spelling that is itself replaced is no target in this round; one that isn't is always left, as replacements have more houses or come first
    return one.join(small(one.select("city", F.col("name").alias("better")), n_one), ["city", "better"], "left_anti"), n_one


def _street(*slots: str) -> Column:
    """One text for a street's slots; a null is told from every text."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(s)), F.lit("-")) for s in slots])


def normalised(records: DataFrame, key: str, address: str, city: str | None = None) -> DataFrame:
    """``key, number, unit, city, name, type, dir`` of each distinct line that has a house number other than 0.

    ``city`` names a column with the record's city; it tells cities from streets, and stands in where a line has
    neither city nor ZIP code. Rows with a null key or a line without number don't come out.
    """
    lines = records.where(F.col(key).isNotNull() & F.col(address).isNotNull()).select(F.col(key).alias("key"), F.col(address).alias("line"), (F.col(city) if city else F.lit(None).cast("string")).alias("city")).distinct()
    t = tokens(F.col("line"))
    # the id, which isn't deterministic, keeps the place of the first number out of lambdas, where it would be worked out for every word
    read = _read(lines.select("key", t.alias("t"), F.array_position(F.transform(t, is_number), F.lit(True)).cast("int").alias("first"), squeezed(F.col("city")).alias("own"), F.monotonically_increasing_id().alias("id")))
    parsed = cut(_with_city(cut(read)))
    lines = cut(_slots(parsed, *cut_counted(_word_classes(parsed))).distinct().withColumn("at", _street("city", "name", "type", "dir")))
    # the mining runs over distinct streets, not over lines; a slip that was delivered again is one slip, so houses are counted
    slots = ["city", "name", "type", "dir"]
    streets = cut(lines.where("city is not null").groupBy(*slots).agg(F.count_distinct("number").alias("n")).withColumns({f"{s}0": F.col(s) for s in ("name", "type", "dir")}))
    houses = cut(lines.where("city is not null").select("city", F.col("name").alias("name0"), "number").distinct())
    room, n_cities = cut_counted(houses.groupBy("city").agg(F.count_distinct("number").alias("room")))
    rounds = []
    while True:
        rewrites = _abbreviations(streets)
        spelt, n_spelt = _spellings(streets, houses, room, n_cities)
        if not rewrites[1] and not n_spelt:
            break
        rounds.append(rewrites)
        streets = _rewritten(streets, *rewrites)
        if n_spelt:
            streets = streets.join(small(spelt, n_spelt), ["city", "name"], "left").withColumn("name", F.coalesce("better", "name")).drop("better")
        streets = cut(streets)
    final = streets.select(_street("city", "name0", "type0", "dir0").alias("at"), F.col("name").alias("__name"), F.col("type").alias("__type"), F.col("dir").alias("__dir"))
    known = salted_join(lines.where("city is not null").drop("name", "type", "dir"), final, "at").select("key", "number", "unit", "city", F.col("__name").alias("name"), F.col("__type").alias("type"), F.col("__dir").alias("dir"))
    # lines whose city isn't known yet have their tokens rewritten all the same
    rest = lines.where("city is null").drop("at")
    for r in rounds:
        rest = _rewritten(rest, *r)
    return cut(known.unionByName(rest.select(*known.columns)).distinct())


def places(lines: DataFrame) -> DataFrame:
    """``key, place``: each line's place with left-out parts filled in; lines that could mean several places don't come out."""
    # cities left out: the only city with such a street
    with_city = lines.where("city is not null")
    of_street = with_city.groupBy("name").agg(F.min("city").alias("c0"), F.max("city").alias("c1")).where("c0 = c1").select("name", F.col("c0").alias("city"))
    lines = cut(with_city.unionByName(salted_join(lines.where("city is null").drop("city"), of_street, "name").select(*with_city.columns)))
    # a street counts as a choice if it has two house numbers or more, however large the others of its name are
    combos = lines.where("type is not null").groupBy("city", "name", "type", "dir").agg((F.min("number") < F.max("number")).alias("real"))
    # a street whose type goes with directions has one on every line; without is left out
    full = combos.withColumn("dirs", F.count("dir").over(Window.partitionBy("city", "name", "type"))).where("dir is not null or dirs = 0")
    streets = full.groupBy("city", "name").agg(F.collect_list(F.struct(F.col("type").alias("t"), F.col("dir").alias("d"), "real")).alias("known"))
    # those with one house number count only where there is no other
    streets = streets.withColumn("known", F.when(F.exists("known", lambda k: k["real"]), F.filter("known", lambda k: k["real"])).otherwise(F.col("known")))
    streets = streets.select(_street("city", "name").alias("at"), F.transform("known", lambda k: F.struct(k["t"].alias("t"), k["d"].alias("d"))).alias("known"))
    fits = F.filter("known", lambda k: (F.col("type").isNull() | (F.col("type") == k["t"])) & (F.col("dir").isNull() | F.coalesce(F.col("dir") == k["d"], F.lit(False))))
    # a name has few streets per city: types x directions
    at = salted_join(lines.withColumn("at", _street("city", "name")), streets, "at", "left").drop("at").withColumn("fit", F.coalesce(fits, F.array().cast("array<struct<t:string,d:string>>")))
    at = cut(at.drop("known"))
    sure = at.where(F.size("fit") == 1)
    unsure = at.where(F.size("fit") > 1).withColumn("at", _street("city", "name", "number"))
    houses = sure.withColumn("at", _street("city", "name", "number")).groupBy("at").agg(F.collect_set(F.element_at("fit", 1)).alias("here"))
    unsure = salted_join(unsure, houses, "at").withColumn("fit", F.array_intersect("fit", "here")).drop("here", "at").where(F.size("fit") == 1)
    odd = at.where(F.size("fit") == 0).withColumn("fit", F.array(F.struct(F.col("type").alias("t"), F.col("dir").alias("d"))))
    street = sure.unionByName(unsure.select(*sure.columns)).unionByName(odd).withColumns({"type": F.element_at("fit", 1)["t"], "dir": F.element_at("fit", 1)["d"]}).drop("fit")
    street = cut(street.select("key", "unit", _street("city", "name", "type", "dir", "number").alias("house")))
    units = street.where("unit is not null").groupBy("house").agg(F.min("unit").alias("u0"), F.max("unit").alias("u1")).where("u0 = u1").select("house", F.col("u0").alias("unit"))
    filled = salted_join(street.where("unit is null").drop("unit"), units, "house", "left").select("key", "unit", "house")
    every = street.where("unit is not null").select("key", "unit", "house").unionByName(filled)
    return every.select("key", F.concat_ws("#", "house", F.coalesce("unit", F.lit(""))).alias("place")).distinct()


def same_place_pairs(records: DataFrame, key: str, address: str, city: str | None = None) -> DataFrame:
    """Distinct (``key_a``, ``key_b``), smaller key first: different keys with lines that denote the same place.

    Lines without a house number, or with number 0, and placeholder words denote no place; null keys and lines are left
    out, repeated lines count once, a key may have several places. Names of more than LONGEST letters match only as they are spelt. An empty table gives no rows; further columns are not
    looked at. Every pair of a place's keys is a row, as the result asks for; a place is found from all lines.
    """
    at = cut(places(normalised(records, key, address, city)))
    a, b = at.select("place", F.col("key").alias("key_a")), at.select("place", F.col("key").alias("key_b"))
    return a.join(b, "place").where("key_a < key_b").select("key_a", "key_b").distinct()
