"""Names in texts and keys: product mentions, grounded numbers, banned terms, fuzzy key joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodemand.functions.scalars import letters_and_digits
from geodemand.session import save_table

# Words too common among product names to identify one.
GENERIC_WORDS = ("tractor", "farm", "type", "with", "unit")


def plain_words(c: str | Column, letters: str = "a-z") -> Column:
    """Lower-case letters of the given alphabet and single blanks only."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), f"[^{letters}]+", " "))


GRAM = 5  # characters of a one-word name that a token is probed with


def _probes_of_names(names: DataFrame) -> DataFrame:
    """What a token must be, end with, begin with or hold to stand for a part of a name: part, kind, probe, word.

    A name of several words stands in a text where a token ends with its first word, the next ones are
    its middle words, and one begins with its last word. A telling word counts as singular or plural.
    """
    w = F.split("name", " ")
    middle = F.transform(F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))), lambda x: _part("is", x))
    several = F.concat(F.array(_part("ends", F.get(w, F.lit(0)))), middle, F.array(_part("begins", F.element_at(w, -1))))
    whole = F.when(F.length("name") > 4, F.when(F.size(w) > 1, several).otherwise(F.array(_part("holds", F.col("name"))))).otherwise(F.array().cast(_PARTS))
    forms = lambda x: F.array(x, F.concat(x, F.lit("s")), F.rtrim(x, F.lit("s")))
    telling = F.flatten(F.transform("words", lambda x: F.transform(forms(x), lambda f: F.struct(F.lit("form").alias("kind"), f.alias("probe"), x.alias("word")))))
    return names.select(F.explode(F.array_distinct(F.concat(whole, telling))).alias("p")).select("p.*").distinct()


_PARTS = "array<struct<kind:string,probe:string,word:string>>"


def _part(kind: str, word: Column) -> Column:
    probe = F.substring(word, 1, GRAM) if kind == "holds" else word
    return F.struct(F.lit(kind).alias("kind"), probe.alias("probe"), word.alias("word"))


def _label(kind: Column, word: Column) -> Column:
    return F.concat(kind, F.lit(":"), word)


def _parts_in(tokens: DataFrame, probes: DataFrame) -> DataFrame:
    """The index of the vocabulary: token and the part of some name it stands for.

    Every distinct token is cut at the lengths that occur among the names, so it gives a number of
    probes that the catalogue bounds, not the texts.
    """
    sizes = {r["kind"]: sorted(r["n"]) for r in probes.groupBy("kind").agg(F.collect_set(F.length("probe")).alias("n")).collect()}
    token, n = F.col("token"), F.length("token")
    cuts = {
        "form": [token], "is": [token],
        "ends": [F.when(n >= i, F.right("token", F.lit(i))) for i in sizes.get("ends", [])],
        "begins": [F.when(n >= i, F.left("token", F.lit(i))) for i in sizes.get("begins", [])],
    }
    tried = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("probe")) for k, cs in cuts.items() if k in sizes for c in cs] or [F.struct(F.lit("").alias("kind"), token.alias("probe"))])
    for i in sizes.get("holds", []):  # every run of i letters, in one pass over the token
        runs = F.regexp_extract_all(token, F.lit(f"(?=(.{{{i}}}))"), F.lit(1))
        tried = F.concat(tried, F.transform(F.array_distinct(runs), lambda g: F.struct(F.lit("holds").alias("kind"), g.alias("probe"))))
    t = tokens.select("token", F.explode(tried).alias("t")).select("token", "t.*").where(F.col("probe").isNotNull())
    met = t.join(probes, ["kind", "probe"]).where((F.col("kind") != "holds") | F.contains(token, F.col("word")))
    return met.select("token", _label(F.col("kind"), F.col("word")).alias("part")).distinct()


def _digest(*lists: str) -> Column:
    """One text that stands for lists of words."""
    return F.sha2(F.concat_ws("\n", *[F.concat_ws("|", c) for c in lists]), 256)


def _held_in_full(q: DataFrame, key: str, held: DataFrame, names: DataFrame) -> DataFrame:
    """Per text with its set of parts (`held`) the names that stand in it in full.

    Sets of parts meet names by these parts; only the texts of a set that has all parts of a name
    of several words are looked at, once for all its names.
    """
    w = names.where(F.length("name") > 4).select("name").distinct()
    words = F.split("name", " ")
    several = F.concat(
        F.array(F.concat(F.lit("ends:"), F.get(words, F.lit(0)))),
        F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda x: F.concat(F.lit("is:"), x)),
        F.array(F.concat(F.lit("begins:"), F.element_at(words, -1))),
    )
    parts = F.array_distinct(F.when(F.size(words) > 1, several).otherwise(F.array(F.concat(F.lit("holds:"), F.col("name")))))
    w = w.select("name", parts.alias("parts"), (F.size(words) > 1).alias("several")).select("name", "several", F.size("parts").alias("m"), F.explode("parts").alias("part"))
    s = held.select("sid", "parts").dropDuplicates(["sid"]).select("sid", F.explode("parts").alias("part"))
    met = s.join(w, "part").groupBy("sid", "name", "several", "m").agg(F.count(F.lit(1)).alias("n")).where("n = m")
    per = met.groupBy("sid").agg(
        F.collect_list(F.when(~F.col("several"), F.col("name"))).alias("sure"), F.collect_list(F.when(F.col("several"), F.col("name"))).alias("asked")
    )
    per = held.select(key, "sid").join(per, "sid")
    looked = per.where(F.size("asked") > 0).join(q, key).select(key, F.concat("sure", F.filter("asked", lambda n: F.contains(F.col("_q"), n))).alias("full"))
    return per.where(F.size("asked") == 0).select(key, F.col("sure").alias("full")).unionByName(looked).select(key, F.array_sort("full").alias("full"))


def product_mentions(
    texts: DataFrame, key: str, text: str, catalogue: DataFrame, generic: tuple = GENERIC_WORDS, letters: str = "a-z"
) -> DataFrame:
    """The product a text speaks of, at most one per text (key: unique per text).

    catalogue: item, name, ceiling. A name of at least five letters standing in full scores twice its
    length; otherwise the share of its telling words found (singular or plural) times its length,
    from one half on. Of the products within 75 % of the best score the one with the widest base
    wins. A product may have several rows, e.g. its id as a second name. `generic` words identify none.

    Names meet the distinct tokens of all texts, and these the texts, so that a text is cut into
    tokens once, whatever the catalogue. Texts with the same set of parts are scored as one.
    """
    q = save_table(texts.select(key, plain_words(text, letters).alias("_q")).where(F.col("_q") != ""), "mention-texts")
    names = catalogue.select("item", "ceiling", plain_words("name", letters).alias("name")).where(F.col("name") != "")
    words = F.filter(F.split("name", " "), lambda w: (F.length(w) > 3) & ~w.isin(*generic))
    names = save_table(names.withColumn("words", words).distinct(), "mention-names")

    tokens = q.select(F.explode(F.split("_q", " ")).alias("token")).distinct()
    index = _parts_in(tokens, _probes_of_names(names))
    per_text = q.select(key, F.explode(F.array_distinct(F.split("_q", " "))).alias("token")).join(index, "token")
    held = per_text.groupBy(key).agg(F.array_sort(F.collect_set("part")).alias("parts"))
    held = save_table(held.withColumn("sid", _digest("parts")), "mention-held")

    full = _held_in_full(q, key, held, names)
    full = held.join(full, key, "left").select(key, "parts", F.coalesce("full", F.array().cast("array<string>")).alias("full"))
    held = save_table(full.withColumn("case", _digest("parts", "full")), "mention-full")
    cases = held.select("case", "parts", "full").dropDuplicates(["case"])

    outright = cases.select("case", F.explode("full").alias("name")).join(names, "name").select("case", "item", "ceiling", (F.length("name") * 2.0).alias("score"))
    forms = cases.select("case", "full", F.transform(F.filter("parts", lambda p: F.startswith(p, F.lit("form:"))), lambda p: F.substring_index(p, ":", -1)).alias("forms"))
    by_word = names.select("name", "item", "ceiling", "words", F.explode(F.array_distinct("words")).alias("word"))
    met = forms.select("case", "full", "forms", F.explode("forms").alias("word")).join(by_word, "word")
    met = met.dropDuplicates(["case", "item", "name", "ceiling"]).where(~F.array_contains("full", F.col("name")))
    share = F.size(F.filter("words", lambda w: F.array_contains("forms", w))) / F.size("words")
    part = met.where(share >= 0.5).select("case", "item", "ceiling", (share * F.length("name")).alias("score"))
    cand = outright.unionByName(part)
    best = cand.groupBy("case").agg(F.max("score").alias("_top")).where(F.col("_top") >= 5)
    close = cand.join(best, "case").where(F.col("score") >= F.col("_top") * 0.75)
    won = close.groupBy("case").agg(
        F.min_by(F.struct("item", "score"), F.struct((-F.col("ceiling")).alias("c"), (-F.col("score")).alias("s"), "item")).alias("b")
    )
    return held.select(key, "case").join(won.select("case", "b.item", "b.score"), "case").select(key, "item", "score")


def ungrounded_numbers(texts: DataFrame, key: str, text: str, facts: DataFrame) -> DataFrame:
    """Numbers of four digits or more that no fact of the same text supports.

    facts: key, fact. Supported means within 2, or 2 % of the fact, whichever is more.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(r"[0-9][0-9,]{3,}"), F.lit(0))
    n = texts.select(key, F.explode(found).alias("token"))
    n = n.withColumn("number", F.regexp_replace("token", ",", "").cast("double"))
    f = facts.select(F.col(key).alias("_k"), "fact")
    ok = F.abs(F.col("number") - F.col("fact")) <= F.greatest(F.lit(2.0), F.abs("fact") * 0.02)
    return n.join(f, (F.col(key) == F.col("_k")) & ok, "left_anti")


def banned_terms(texts: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """Texts that contain any banned term, with the terms found."""
    low = F.lower(text)
    hits = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))
    return texts.select(key, hits.alias("terms")).where(F.size("terms") > 0)


def _grams(c: str) -> Column:
    """Every run of one to three characters of a key."""
    runs = lambda n: F.when(
        F.length(c) >= n,
        F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n))),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(runs(1), runs(2), runs(3)))


def candidates(parts: DataFrame, wholes: DataFrame, by: str) -> DataFrame:
    """(by, part, whole) where the whole has the part's rarest run and is no shorter.

    Of the runs of a part, three characters each, the one that fewest wholes have is looked up, so
    names that share a stem meet over what tells them apart.
    """
    runs = wholes.where(F.length("x") > 0).select(by, F.col("x").alias("whole"), F.explode(_grams("x")).alias("_g"))
    counts = runs.groupBy(by, "_g").agg(F.count(F.lit(1)).alias("_n"))
    own = F.when(F.length("x") < 3, F.array("x")).otherwise(F.regexp_extract_all("x", F.lit("(?=(.{3}))"), F.lit(1)))
    probes = parts.where(F.length("x") > 0).select(by, F.col("x").alias("part"), F.explode(F.array_distinct(own)).alias("_g"))
    known = probes.join(counts, [by, "_g"], "left").groupBy(by, "part").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("_r"))
    rarest = known.where("_r.n > 0").select(by, "part", F.col("_r._g").alias("_g"))
    return rarest.join(runs, [by, "_g"]).where(F.length("whole") >= F.length("part")).select(by, "part", "whole")


def contained(parts: DataFrame, wholes: DataFrame, by: str) -> DataFrame:
    """(by, part, whole) of distinct keys `x` of both sides where the whole contains the part."""
    return candidates(parts, wholes, by).where(F.contains(F.col("whole"), F.col("part")))


def alias_join(rows: DataFrame, key: str, state: str, name: str, geo: DataFrame, aliases: DataFrame) -> DataFrame:
    """Match names to geometry keys of the same state: alias candidates in order, then the exact
    key, then containment either way; keys taken more than once are flagged as shared.

    geo: state_key, name_key. aliases: name_key, candidates (ordered array).
    """
    r = rows.select(key, letters_and_digits(state).alias("state_key"), letters_and_digits(name).alias("_n"))
    a = aliases.select(F.col("name_key").alias("_n"), "candidates")
    r = r.join(a, "_n", "left")
    tries = F.concat(F.coalesce("candidates", F.array().cast("array<string>")), F.array("_n"))
    t = r.select(key, "state_key", F.posexplode(tries).alias("prio", "name_key"))
    first = t.join(geo, ["state_key", "name_key"]).groupBy(key).agg(F.min_by("name_key", "prio").alias("geo_key"))
    rest = r.join(first, key, "left_anti").select(key, "state_key", "_n")
    names, keys = rest.select("state_key", F.col("_n").alias("x")).distinct(), geo.select("state_key", F.col("name_key").alias("x")).distinct()
    in_geo = contained(names, keys, "state_key").select("state_key", F.col("part").alias("_n"), F.col("whole").alias("name_key"))
    in_name = contained(keys, names, "state_key").select("state_key", F.col("whole").alias("_n"), F.col("part").alias("name_key"))
    loose = rest.join(in_geo.unionByName(in_name), ["state_key", "_n"]).groupBy(key).agg(F.min("name_key").alias("geo_key"))
    found = first.withColumn("how", F.lit("direct")).unionByName(loose.withColumn("how", F.lit("contained")))
    m = r.select(key, "state_key").join(found, key, "left")
    uses = m.where("geo_key is not null").groupBy("state_key", "geo_key").agg(F.count(F.lit(1)).alias("_u"))
    return m.join(uses, ["state_key", "geo_key"], "left").select(
        key, "state_key", "geo_key", "how", F.coalesce(F.col("_u") > 1, F.lit(False)).alias("shared")
    )
