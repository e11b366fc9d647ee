"""Receipts: lines of text, match to a catalogue, rollup by product."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.operators.offers import identity_keywords, name_has_phrase, strip_pack_noise

#: Lines of a receipt that are no product, and products that are fees; fixed values.
NO_LINE = r"(?i)\b(sub\s*total|subtotal|total|balance|change|hst|gst|pst|qst|tvq|tax|debit|credit|visa|mastercard|amex|cash|tender|payment|change due|you saved|savings|air\s*miles|pc\s*optimum|optimum|triangle|thank you|cashier|served by|store\s*#|tel\.?|www\.|http|invoice|receipt\s*#|gst\/hst|#\s*\d{5}|rounded|refund|void|approved|auth(?:orization)?|mid\b|tid\b|chip|pin\s*verified|copy)\b"
NO_PRODUCT = r"(?i)\b(paper bag|reusable bag|plastic bag|bag fee|bottle deposit|crv|eco fee|weighing fee)\b"
PRICE_AT_END = r"(?i)^(.*?)(?:\s{1,}|\t+)(\d+[.,]\d{2})\s*[A-Z]?$"
ONLY_PRICE = r"(?i)^\$?\s*(\d+[.,]\d{2})\s*[A-Z]?$"
QTY_PREFIX = r"(?i)^(\d+(?:[.,]\d+)?)\s*[@x×]\s+"
QTY_AT_PRICE = r"(?i)(\d+)\s*@\s*\$?\d+[.,]\d{2}"


def clean_name(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"[|*]+", " "), r"\s+", " "))


def parse_price(raw: Column) -> Column:
    """A positive amount with a dot or a comma, else null."""
    n = F.replace(raw, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(n > 0, n)


def is_noise(line: Column) -> Column:
    """Totals, payments, dates, times, long numbers and lines under three letters."""
    t = F.trim(line)
    return (F.length(t) < 3) | F.regexp_replace(t, r"\s", "").rlike(r"^\d{6,}$") | t.rlike(NO_LINE) | t.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|^\d{1,2}:\d{2}")


def parse_lines(receipts: DataFrame) -> DataFrame:
    """(receipt_id, line_no, name, qty, price) of receipts (receipt_id, text), each name once by receipt, the first line of it.

    A line ends in its price, or is followed by a line that is only a price; a name at the very end may lack one. 'N @' or 'N x'
    before a name, or 'N @ price', is a quantity. Noise and fees are left out, and so is a name before another name. Null texts give no rows.
    """
    lines = receipts.select("receipt_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "raw")).withColumn("raw", F.trim("raw")).where("raw <> ''")
    raw, only = F.col("raw"), F.col("raw").rlike(ONLY_PRICE)
    named = F.trim(F.regexp_extract("raw", PRICE_AT_END, 1))
    kind = (
        F.when(only, "price").when(is_noise(raw), "noise").when(raw.rlike(PRICE_AT_END) & (F.length(named) >= 3), "priced").when(raw.rlike(NO_PRODUCT), "noise").otherwise("name")
    )
    own = parse_price(F.regexp_extract("raw", ONLY_PRICE, 1))
    rows = lines.withColumns({"kind": kind, "own": own}).where("kind <> 'price' or own is not null")
    w = Window.partitionBy("receipt_id").orderBy("line_no")  # the lines of one receipt
    rows = rows.withColumns({"next": F.lead("kind").over(w), "after": F.lead("own").over(w)})
    name = F.when(F.col("kind") == "priced", named).when((F.col("kind") == "name") & (F.col("next").isNull() | (F.col("next") == "price")), raw)
    price = F.when(F.col("kind") == "priced", parse_price(F.regexp_extract("raw", PRICE_AT_END, 2))).otherwise(F.col("after"))
    rows = rows.withColumns({"said": name, "price": price}).where("said is not null")
    qty = F.coalesce(F.nullif(F.regexp_extract("said", QTY_PREFIX, 1), F.lit("")), F.nullif(F.regexp_extract("said", QTY_AT_PRICE, 1), F.lit("")))
    rows = rows.select("receipt_id", "line_no", clean_name(F.regexp_replace("said", QTY_PREFIX, "")).alias("name"), parse_price(qty).alias("qty"), "price")
    rows = rows.where((F.length("name") >= 3) & ~is_noise(F.col("name")) & ~F.col("name").rlike(NO_PRODUCT))
    first = rows.groupBy("receipt_id", F.lower("name")).agg(F.min_by(F.struct("line_no", "name", "qty", "price"), "line_no").alias("m"))
    return first.select("receipt_id", "m.*").sortWithinPartitions("receipt_id", "line_no")


def staple_id(name: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(strip_pack_noise(name)), "[^a-z0-9]+", "_"), "^_|_$", "")
    return F.concat(F.lit("receipt_"), F.coalesce(F.nullif(F.substring(slug, 1, 42), F.lit("")), F.lit("item")))


def infer_category(name: Column) -> Column:
    """Category of a product by words of its name; the patterns are fixed values."""
    t = F.lower(name)
    return (
        F.when(t.rlike(r"\b(frozen|iqf|alasko)\b"), "frozen")
        .when(t.rlike(r"\b(cup|lid|lids|glove|gloves|foil|napkin|tray|wraps?|bagasse|nitrile|paddle|mitt|strainer|tablecloth)\b"), "supplies")
        .when(t.rlike(r"\b(milk|cheese|yogurt|butter|cream|ricotta|mozzarella|cheddar|havarti|muenster)\b"), "dairy")
        .when(t.rlike(r"\b(tomato|pepper|onion|lettuce|celery|carrot|apple|banana|berr|grape|melon|pear|peach|plum|lime|lemon|parsley|cilantro|garlic|potato|avocado|cucumber|mushroom|radish|broccoli|cauliflower|cabbage|spinach|kale|herb)\b"), "produce")
        .otherwise("grocery")
    )


#: Words for shell eggs, and what only looks like them; fixed values.
EGGS, NO_EGGS = r"яйц|яєц|\blarge\s+eggs?\b|\beggs?\b", r"eggplant|баклажан|egg\s*whites?|яєчн\w*\s*білк|\bбілок\b|\bбілка\b"
EGG_ITEM = "large_eggs_dozen"
GRAM = 3


def asks_for_eggs(query: Column) -> Column:
    t = F.lower(F.trim(query))
    return F.coalesce(t.rlike(EGGS) & ~t.rlike(NO_EGGS), F.lit(False))


def _grams(text: Column, size: int) -> Column:
    """The distinct substrings of `size` letters."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))


def _rarest(needles: DataFrame, grams: DataFrame) -> DataFrame:
    """needles (q) with the substring `g` of their longest words, of three letters or as many as these have, that the fewest items hold."""
    words = F.filter(F.split("q", r"\s+"), lambda w: w != "")
    size = F.least(F.lit(GRAM), F.array_max(F.transform(words, lambda w: F.length(w))))
    pieces = F.flatten(F.transform(words, lambda w: F.array_distinct(F.when(size == 3, _grams(w, 3)).when(size == 2, _grams(w, 2)).otherwise(_grams(w, 1)))))
    held = grams.groupBy("g").agg(F.count("*").alias("n"))
    keyed = needles.select("q", F.explode(F.array_distinct(pieces)).alias("g")).join(held, "g", "left")
    return keyed.groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))["g"].alias("g"))


def match_lines(lines: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(name, id, label, score) of the best catalogue item (id, label and perhaps hay) for each distinct line name; names without a match are absent.

    An item matches a query if its text (hay, or label and id) holds the query, or all its words of two letters or more, if these are
    several, or each of its words, of one letter too, as a word. A name asks as it is and without sizes. Score: 100 for the label itself,
    80 for its beginning, 60 within it, 40 within the id, else 20. Ties go to the first label, then id. Below 40 the best
    item counts only if its label or id holds all words of four letters or more that are no sizes. A name that asks for shell eggs matches
    large_eggs_dozen, with a null score, or nothing. Null and blank names have no match; items with a null label have an empty one.

    Whatever matches holds every letter sequence of the query's longest word, so candidates come from an equi-join on the rarest
    of its three-letter pieces (two or one for shorter words): no link is lost, and there is no cross join.
    """
    names = lines.select("name").where("trim(name) <> ''").distinct()
    stripped = F.coalesce(F.nullif(strip_pack_noise(F.trim("name")), F.lit("")), F.trim("name"))
    asked = names.withColumn("eggs", asks_for_eggs(F.col("name")) | asks_for_eggs(stripped)).select(
        "name", "eggs", F.explode(F.array_distinct(F.array(F.lower(stripped), F.lower(F.trim("name"))))).alias("q")
    )
    label = F.coalesce("label", F.lit(""))
    spaced = F.replace("id", F.lit("_"), F.lit(" "))
    plain = F.concat_ws(" ", label, spaced)
    text = F.coalesce(F.nullif(F.trim("hay"), F.lit("")), plain) if "hay" in catalogue.columns else plain
    hay = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    items = catalogue.select("id", label.alias("label"), hay.alias("hay")).distinct().withColumn("item", F.xxhash64("id", "label", "hay"))
    grams = items.select("item", F.explode(F.concat(*[_grams(F.col("hay"), k) for k in range(1, GRAM + 1)])).alias("g"))
    others = asked.where("not eggs")
    keyed = others.join(_rarest(others.select("q").distinct(), grams), "q")
    pairs = keyed.join(grams, "g").select("name", "q", "item").join(items, "item")
    parts = F.filter(F.split("q", r"\s+"), lambda p: F.length(p) >= 2)
    holds = F.col("hay").contains(F.col("q")) | ((F.size(parts) > 1) & F.forall(parts, lambda p: F.col("hay").contains(p))) | name_has_phrase(F.col("hay"), F.col("q"), F.lit(True))
    low = F.lower("label")
    of = lambda s: F.when(low == s, 100).when(low.startswith(s), 80).when(low.contains(s), 60).when(spaced.contains(s), 40).otherwise(20)
    # an item that one of the two queries finds is scored by the better of both
    ways = F.greatest(of(F.lower(F.coalesce(F.nullif(strip_pack_noise(F.trim("name")), F.lit("")), F.trim("name")))), of(F.lower(F.trim("name"))))
    found = pairs.where(holds).withColumn("score", ways)
    best = found.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("minus"), low.alias("low"), "label", "id")).alias("m"))
    words = identity_keywords(F.filter(F.split(strip_pack_noise(F.trim("name")), r"\s+"), lambda p: F.length(p) >= 4))
    whole = F.lower(F.concat_ws(" ", "m.label", "m.id"))
    sure = (F.col("m.minus") <= -40) | ((F.size(words) > 0) & F.forall(words, lambda w: whole.contains(F.lower(w))))
    eggs = items.where(F.col("id") == EGG_ITEM).groupBy("id").agg(F.min("label").alias("label"))
    boiled = asked.where("eggs").select("name").distinct().join(F.broadcast(eggs), F.lit(True), "inner")  # one row at most
    return best.where(sure).select("name", "m.id", "m.label", (-F.col("m.minus")).alias("score")).unionByName(
        boiled.select("name", "id", "label", F.lit(None).cast("int").alias("score"))
    )


#: A number that has been put behind an id: from 2 on, without leading zeros.
NUMBERED = r"^(.*)_([2-9]|[1-9][0-9]+)$"


def allocate(requests: DataFrame, taken: DataFrame, order: list[str]) -> DataFrame:
    """requests (base and other columns) with `id`: base, base_2, base_3 and so on, the first that is free when its turn by `order` comes.

    taken: id. order: columns that order all requests, without ties. Ids that end in numbers can meet those of other bases (x_2 is the
    second x and the first x_2). A base that meets no other is numbered by windows: the k-th request takes the k-th place that is not taken, and
    a running count of gaps tells which. Bases that meet share a family, named without its numbers, whose requests are dealt with one
    after another in one group; nothing else depends on the order. Null bases get no id.
    """
    known = [c for c in requests.columns if c != "base"]
    stem = lambda c: F.regexp_replace(c, r"(_([2-9]|[1-9][0-9]+))+$", "")
    bases = requests.where("base is not null").groupBy("base").agg(F.count("*").alias("n")).withColumn("family", stem(F.col("base")))
    crowded = bases.groupBy("family").agg(F.count("*").alias("k")).where("k > 1").select("family", F.lit(True).alias("crowded"))
    marked = requests.withColumn("family", stem(F.col("base"))).join(crowded, "family", "left")
    alone = marked.where("crowded is null")
    number = F.when(F.col("id") == F.col("base"), 1).when(F.regexp_extract("id", NUMBERED, 1) == F.col("base"), F.regexp_extract("id", NUMBERED, 2).try_cast("long"))
    named = taken.select("id").where("id is not null").distinct()
    keys = F.array_distinct(F.array("id", F.nullif(F.regexp_extract("id", NUMBERED, 1), F.lit(""))))
    met = named.select("id", F.explode(keys).alias("base")).join(bases.select("base"), "base").select("base", number.cast("long").alias("place")).where("place is not null")
    turn = Window.partitionBy("base").orderBy(*order)
    gaps = met.select("base", (F.col("place") - F.row_number().over(Window.partitionBy("base").orderBy("place")) + 1).cast("long").alias("k"), F.lit(1).alias("gap"), F.lit(None).cast("long").alias("turn"))
    asked = alone.withColumn("turn", F.row_number().over(turn).cast("long"))
    both = gaps.unionByName(asked.where("base is not null").select("base", F.col("turn").alias("k"), F.lit(0).alias("gap"), "turn"))
    passed = F.sum("gap").over(Window.partitionBy("base").orderBy("k", F.col("gap").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    places = both.withColumn("place", F.col("k") + passed).where("turn is not null").select("base", "turn", "place")
    made = asked.join(places, ["base", "turn"], "left").withColumn("id", F.when(F.col("place") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("place").cast("string"))))
    made = made.select("base", *known, "id")

    def one_by_one(key: tuple, mine: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        used, out, begin = set(held["id"]), [], {}
        mine = mine.sort_values(order, ignore_index=True)
        for base in mine["base"]:
            n = begin.get(base, 1)
            while (name := base if n == 1 else f"{base}_{n}") in used:
                n += 1
            begin[base] = n + 1
            used.add(name)
            out.append(name)
        return mine.drop(columns=["family", "crowded"]).assign(id=out)

    kind = ", ".join(f"`{c}` {t}" for c, t in requests.select("base", *known).dtypes) + ", id string"
    families = marked.where("crowded").select("base", *known, "family", "crowded").groupBy("family")
    held = named.withColumn("family", stem(F.col("id"))).join(crowded.select("family"), "family", "left_semi").groupBy("family")
    return made.unionByName(families.cogroup(held).applyInPandas(one_by_one, kind))


def decide_lines(lines: DataFrame, catalogue: DataFrame, occupied: DataFrame) -> DataFrame:
    """(receipt_id, line_no, name, status, id, label, category, match_mode, words): what becomes of each line of a receipt.

    lines: receipt_id, line_no, name. skip: a fee or no product. existing: id and label of the catalogue item of match_lines. new: a draft with an
    id that neither the catalogue nor occupied (id) has, given in the order of (receipt_id, line_no). words: up to four that a later offer has one of. Null names
    are skipped; repeated lines are decided each by itself.
    """
    rows = lines.select("receipt_id", "line_no", "name")
    skip = F.col("name").isNull() | F.col("name").rlike(NO_PRODUCT) | is_noise(F.col("name"))
    found = match_lines(rows.where(~skip), catalogue).select("name", F.col("id").alias("known_id"), F.col("label").alias("known_label"))
    status = F.when(F.coalesce(skip, F.lit(True)), "skip").when(F.col("known_id").isNotNull(), "existing").otherwise("new")
    rows = rows.join(found, "name", "left").withColumn("status", status)
    label = F.substring(clean_name(F.col("name")), 1, 80)
    category = infer_category(label)
    words = F.slice(identity_keywords(F.filter(F.split(strip_pack_noise(label), r"\s+"), lambda w: F.length(w) >= 4)), 1, 4)
    drafts = rows.where("status = 'new'").select("receipt_id", "line_no", "name", staple_id(label).alias("base"))
    given = allocate(drafts, catalogue.select("id").unionByName(occupied.select("id")), ["receipt_id", "line_no", "name"])
    none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    new = given.select(
        "receipt_id", "line_no", "name", F.lit("new").alias("status"), "id", label.alias("label"), category.alias("category"),
        F.when(category.isin("produce", "frozen", "supplies"), "cheapest_equivalent").otherwise("exact").alias("match_mode"), words.alias("words"),
    )
    others = rows.where("status <> 'new'").select(
        "receipt_id", "line_no", "name", "status", F.col("known_id").alias("id"), F.col("known_label").alias("label"), *none("category", "match_mode"), F.lit(None).cast("array<string>").alias("words")
    )
    return others.unionByName(new)


def roll_up(rows: DataFrame) -> DataFrame:
    """(store, upc, n, latest_price, name) of receipt rows (store, upc, at, price, name): the price of the latest row, the commonest name, the smaller among equals.

    Two map-side aggregations on the same keys: first by name, so a product on a
    third of all receipts reaches a task as a few rows.
    """
    by_name = rows.groupBy("store", "upc", "name").agg(F.count("*").alias("k"), F.max(F.struct("at", "price")).alias("last"))
    best: Column = F.min(F.struct((-F.col("k")).alias("k"), "name"))
    return by_name.groupBy("store", "upc").agg(F.sum("k").alias("n"), F.max("last").alias("last"), best.alias("b")).select(
        "store", "upc", "n", F.col("last.price").alias("latest_price"), F.col("b.name").alias("name")
    )
