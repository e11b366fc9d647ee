"""Product identity: candidate pairs, scores, barcodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import text, units
from larder.functions.expr import let


#: Units, which say nothing about the product, and words of which two products never have different ones (with words of which both
#: must have one for the rule to count); fixed values.
UNIT_TOKENS = ["kg", "g", "l", "ml", "lb", "oz", "ct", "litre", "liter", "gram", "kilogram"]
CONFLICTS = [
    (["oat", "almond", "soy", "coconut"], []),
    (["salted", "unsalted"], []),
    (["grape", "cherry", "beefsteak", "roma", "vine"], ["tomato"]),
    (["canola", "olive", "vegetable", "sunflower"], ["oil"]),
    (["white", "brown"], ["sugar", "rice"]),
    (["decaf"], []),
    (["classic", "mountain", "silk"], ["coffee", "folgers"]),
    (["light", "medium", "dark"], ["coffee", "roast"]),
    (["breast", "thigh", "wing"], []),
    (["english", "field"], ["cucumber"]),
    (["red", "green", "yellow"], ["pepper", "bell"]),
    (["vanilla", "chocolate"], []),
    (["frozen", "fresh"], ["strawberry", "blueberry", "spinach"]),
    (["wheat", "oat"], ["bran"]),
    (["2pct", "homo", "skim", "1pct"], ["milk"]),
    (["large", "medium", "small", "xl"], ["egg"]),
]
COUNT_UNIT = r"(?i)^(ct|count|ea|each|pk|pack|pcs|eggs?)$"
THRESHOLD = 0.85


def fold(records: DataFrame, fields: list[str], key: str) -> DataFrame:
    """One row per set of equal `fields`, with its least `key` and its number of members: copies cost a pair join nothing."""
    return records.groupBy(*fields).agg(F.min(key).alias(key), F.count("*").alias("members"))


def candidate_pairs(records: DataFrame, key: str, blocks: list[list[str]]) -> DataFrame:
    """(left, right) structs of every two records that agree in all columns of some block, the smaller key on the left, each pair once.

    Equi-joins, one for each block; a pair that an earlier block gives is left out of a later one. No
    partner is dropped: choose blocks fine enough, and fold equal records first. Few bytes of records make many pairs, so they are dealt
    over all partitions of the session.
    """
    row, n = F.struct(*records.columns), int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = None
    for i, block in enumerate(blocks):
        dealt = records.repartition(n, *block)
        a, b = dealt.select(*block, row.alias("left")), dealt.select(*block, row.alias("right"))
        pairs = a.join(b, block).where(F.col(f"left.{key}") < F.col(f"right.{key}"))
        for before in blocks[:i]:
            same = [F.coalesce(F.col(f"left.{c}") == F.col(f"right.{c}"), F.lit(False)) for c in before]
            pairs = pairs.where(~F.forall(F.array(*same), lambda x: x))
        pairs = pairs.select("left", "right")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def brand_tokens(brand: Column) -> Column:
    """Words of a brand and, if there are two or more, their initials."""
    words = text.name_tokens(F.coalesce(brand, F.lit("")))
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    return F.when(F.length(initials) >= 2, F.array_union(words, F.array(initials))).otherwise(F.array_distinct(words))


def content_tokens(name: Column, brand: Column) -> Column:
    """Distinct words of a name without brand, units and numbers."""
    words = F.array_except(text.name_tokens(F.coalesce(name, F.lit(""))), brand_tokens(brand))
    return F.filter(words, lambda w: ~w.isin(*UNIT_TOKENS, "pct") & ~w.rlike(r"^\d+(\.\d+)?%?$"))


def record_jaccard(content_a: Column, content_b: Column, name_a: Column, name_b: Column) -> Column:
    """Of content words; of all words where a name has none."""
    return token_jaccard(content_a, content_b, text.name_tokens(name_a), text.name_tokens(name_b))


def token_jaccard(content_a: Column, content_b: Column, all_a: Column, all_b: Column) -> Column:
    """record_jaccard of words that have been taken from the names."""
    empty = (F.size(content_a) == 0) | (F.size(content_b) == 0)
    return F.when(empty, text.jaccard(all_a, all_b)).otherwise(text.jaccard(content_a, content_b))


def conflict_groups(words: Column) -> Column:
    """Bits of the rules of conflict() that a product with these words can break; two without a common bit have no conflict."""
    has = lambda own: F.coalesce(F.arrays_overlap(words, F.array(*map(F.lit, own))), F.lit(False))
    rules = [has(group) & has(require) if require else has(group) for group, require in CONFLICTS] + [has(["coffee"])]
    return sum((F.when(rule, 1 << i).otherwise(0) for i, rule in enumerate(rules)), F.lit(0))


def conflict(words_a: Column, words_b: Column) -> Column:
    """'x vs y' of the first group of words of which two products have different ones, else null. words: of brand and name."""
    rules = []
    for group, require in CONFLICTS:
        own = F.array(*map(F.lit, group))
        x, y = F.array_intersect(own, words_a), F.array_intersect(own, words_b)
        rule = (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)
        if require:
            needed = F.array(*map(F.lit, require))
            rule = rule & (F.size(F.array_intersect(F.array_intersect(needed, words_a), words_b)) > 0)
        rules.append(F.when(rule, F.concat(F.get(x, F.lit(0)), F.lit(" vs "), F.get(y, F.lit(0)))))
    has = F.array_contains
    decaf = (has(words_a, "decaf") != has(words_b, "decaf")) & has(words_a, "coffee") & has(words_b, "coffee")
    return F.coalesce(*rules, F.when(decaf, "decaf vs caffeinated"))


def record_count(name: Column, value: Column, unit: Column) -> Column:
    """Pieces of a record: its size in a unit that counts, else the number its name gives; null if neither."""
    t = F.lower(F.concat_ws(" ", name, F.coalesce(unit, F.lit(""))))
    n = lambda p: F.regexp_extract(t, p, 1).try_cast("double")
    found = F.coalesce(n(r"\b(\d+)\s*(?:ct|count|pk|pcs|pieces|eggs?)\b"), n(r"\b(\d+)\s*pack\b"))
    return F.when((value > 0) & unit.rlike(COUNT_UNIT), value).otherwise(F.when(found > 0, found))


def record_kg(name: Column, value: Column, unit: Column) -> Column:
    """Kilograms of a record: its size, else what its text names; null if neither."""
    own = units.to_kg(value, unit)
    text_ = units.parse_mass(F.concat_ws(" ", name, value.cast("string"), unit))["kg"]
    return F.when((value > 0) & ~unit.rlike(COUNT_UNIT) & (own > 0), own).otherwise(F.when(text_ > 0, text_))


def structured_score(jaccard: Column, brand: Column, size: Column, same_category: Column, shared: Column | None = None, conflict: Column | None = None) -> Column:
    """0 to 1: half the Jaccard of content words with awards for brand, size and category; weights are fixed values.

    shared: content words in common, of which two lift pairs of agreeing brand and size; conflict: null if there is none.
    """
    agree, clear = brand.isin("exact", "partial") & size.isin("same", "close"), F.lit(True) if conflict is None else conflict.isNull()
    begin = 0.5 * jaccard + F.when(brand == "exact", 0.28).when(brand == "partial", 0.16).when(brand == "mismatch", -0.2).otherwise(0.0)
    begin = begin + F.when(size == "same", 0.22).when(size == "close", 0.1).otherwise(0.0)
    category = F.when(same_category.isNull(), 0.0).when(same_category, 0.08).otherwise(-0.12)
    alike = (jaccard >= 0.85) & (size != "different") & (brand != "mismatch")
    lifted = F.lit(False) if shared is None else (shared >= 2) & agree & clear
    floor = F.when(alike, 0.9).when(lifted, 0.88).otherwise(float("-inf"))
    cap = F.when(clear, 1.0).otherwise(0.4)
    grown = F.least(begin, F.when(size == "different", 0.42).otherwise(float("inf"))) + category + F.when(agree, 0.08).otherwise(0.0)
    return F.greatest(F.least(F.greatest(grown, floor), cap), F.lit(0.0))


def linkage_weight(jaccard: Column, brand: Column, size: Column, same_category: Column, barcodes_differ: Column | None = None, conflict: Column | None = None) -> Column:
    """Sum of log2 agreement weights with a prior of -4.6; fixed values."""
    apart = F.lit(0.0) if barcodes_differ is None else F.when(barcodes_differ, -8.0).otherwise(0.0)
    clash = F.lit(0.0) if conflict is None else F.when(conflict.isNotNull(), -6.0).otherwise(0.0)
    return (
        F.lit(-4.6)
        + F.when(jaccard >= 0.85, 5.0).when(jaccard >= 0.6, 3.0).when(jaccard >= 0.4, 1.0).otherwise(-3.0)
        + F.when(brand == "exact", 4.0).when(brand == "partial", 2.0).when(brand == "mismatch", -3.0).otherwise(0.0)
        + F.when(size == "same", 3.5).when(size == "close", 1.0).when(size == "different", -5.0).otherwise(0.0)
        + F.when(same_category.isNull(), 0.0).when(same_category, 1.5).otherwise(-2.5)
        + apart + clash
    )


def linkage_probability(weight: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(2.0), -weight))


def decision(confidence: Column, threshold: float = 0.85) -> Column:
    """auto_linked, needs_review or rejected; the confidence is rounded to three digits first."""
    rounded = F.floor(confidence * 1000 + 0.5) / 1000
    return F.when(rounded >= threshold, "auto_linked").when(rounded >= 0.5, "needs_review").otherwise("rejected")


def prepared(records: DataFrame) -> DataFrame:
    """Adds the columns that match compares, all that can be said of one record: content, words, tokens, upc, kg, pieces, maker, kind, groups.

    records: name, brand, size_value, size_unit, category, barcode, and any others.
    """
    c = F.col
    plain = lambda x: text.normalize_name(F.coalesce(c(x), F.lit("")))
    made = records.withColumns({
        "content": content_tokens(c("name"), c("brand")), "words": text.name_tokens(F.concat_ws(" ", F.coalesce("brand", F.lit("")), "name")),
        "upc": text.normalize_upc(c("barcode")), "kg": record_kg(c("name"), c("size_value"), c("size_unit")), "pieces": record_count(c("name"), c("size_value"), c("size_unit")),
        "tokens": text.name_tokens(c("name")), "maker": plain("brand"), "kind": plain("category"),
    })
    return made.withColumn("groups", conflict_groups(c("words")))


def match(a: Column, b: Column, mapped: Column, verified: Column, threshold: float = THRESHOLD) -> Column:
    """struct<method, confidence, decision, verified, score, probability, reason> of two prepared records.

    The first stage that links: equal barcodes, a saved mapping (mapped), the structured score, the linkage
    probability; different sizes, barcodes or a conflict block the last two. What is left is at best a case for review.
    """
    return decided(compared(a, b), mapped, verified, threshold)


def compared(a: Column, b: Column) -> Column:
    """All that match finds in two prepared records themselves: facts, score and chance. A few scalars, so what joins pairs moves no records."""
    x, y = a["upc"], b["upc"]
    both = F.coalesce((x != "") & (y != ""), F.lit(False))
    tail = F.when(F.length(x) >= F.length(y), x.endswith(y)).otherwise(y.endswith(x)) & (F.least(F.length(x), F.length(y)) >= 8)
    facts = F.struct(
        (both & F.coalesce((x == y) | tail, F.lit(False))).alias("same_code"), both.alias("both"), token_jaccard(a["content"], b["content"], a["tokens"], b["tokens"]).alias("jac"),
        text.names_match(a["maker"], b["maker"]).alias("brand"), units.size_agreement(a["kg"], b["kg"], a["pieces"], b["pieces"]).alias("size"),
        F.when((a["kind"] != "") & (b["kind"] != ""), a["kind"] == b["kind"]).alias("category"),
        F.when(a["groups"].bitwiseAND(b["groups"]) != 0, conflict(a["words"], b["words"])).alias("clash"), F.size(F.array_intersect(a["content"], b["content"])).alias("shared"),
    )

    def scored(f: Column) -> Column:
        other = f["both"] & ~f["same_code"]
        score = structured_score(f["jac"], f["brand"], f["size"], f["category"], f["shared"], f["clash"])
        chance = linkage_probability(linkage_weight(f["jac"], f["brand"], f["size"], f["category"], other, f["clash"]))
        kept = [f[c].alias(c) for c in ("same_code", "jac", "size", "clash")]
        return F.struct(*kept, other.alias("other_code"), score.alias("score"), chance.alias("chance"))

    return let(facts, scored)


def decided(found: Column, mapped: Column, verified: Column, threshold: float = THRESHOLD) -> Column:
    """match of what compared() found."""
    said = F.struct(F.coalesce(mapped, F.lit(False)).alias("mapped"), F.coalesce(verified, F.lit(False)).alias("verified"))
    return let(F.struct(found.alias("f"), said.alias("m")), lambda s: _decided(s["f"], s["m"], threshold))


def _decided(f: Column, said: Column, threshold: float) -> Column:
    score, chance = f["score"], f["chance"]
    jac, clear = f["jac"], (f["size"] != "different") & f["clash"].isNull()
    open_ = clear & ~f["other_code"]
    structured, alike = (score >= threshold) & open_, (jac >= 0.35) & clear
    linked = (chance >= threshold) & open_ & (jac >= 0.55) & (score >= 0.7)
    method = (
        F.when(f["same_code"], "upc").when(said["mapped"], "manual_mapping").when(structured, "structured").when(linked, "fellegi_sunter")
        .when(alike, "semantic_fallback").when(chance >= score, "fellegi_sunter").otherwise("structured")
    )
    confidence = (
        F.when(f["same_code"] | said["mapped"], 1.0).when(structured, score).when(linked, chance)
        .when(alike, F.least(F.lit(0.62), 0.35 + jac * 0.35)).otherwise(F.greatest(score, chance))
    )
    rounded = F.floor(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)) * 1000 + 0.5) / 1000
    reason = F.when(f["other_code"], "different barcodes").when(f["size"] == "different", "different sizes").otherwise(f["clash"])

    def made(m: Column) -> Column:
        short = (m["method"] == "semantic_fallback") | (m["confidence"] < threshold)
        decision = F.when(m["sure"], "auto_linked").when(short, F.when(m["confidence"] >= 0.5, "needs_review").otherwise("rejected")).otherwise("auto_linked")
        return F.struct(
            m["method"].alias("method"), m["confidence"].alias("confidence"), decision.alias("decision"), m["sure"].alias("verified"),
            score.alias("score"), chance.alias("probability"), F.when(~open_, reason).alias("reason"),
        )

    return let(F.struct(method.alias("method"), rounded.alias("confidence"), (said["mapped"] & said["verified"] & ~f["same_code"]).alias("sure")), made)


def match_products(pairs: DataFrame, mappings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds `match` to pairs (left, right) of prepared records with the columns retailer and product_id.

    mappings: left_retailer, left_id, right_retailer, right_id, verified; either order counts. A repeated
    mapping is verified if any of its rows is.
    """
    side = lambda r, i: F.concat_ws("::", r, i)
    x, y = side(F.col("left_retailer"), F.col("left_id")), side(F.col("right_retailer"), F.col("right_id"))
    known = mappings.select(F.least(x, y).alias("pair_a"), F.greatest(x, y).alias("pair_b"), "verified").groupBy("pair_a", "pair_b").agg(F.bool_or("verified").alias("verified"))
    p, q = side(F.col("left.retailer"), F.col("left.product_id")), side(F.col("right.retailer"), F.col("right.product_id"))
    keyed = pairs.withColumns({"pair_a": F.least(p, q), "pair_b": F.greatest(p, q), "found": compared(F.col("left"), F.col("right"))})
    joined = keyed.join(known.withColumn("mapped", F.lit(True)), ["pair_a", "pair_b"], "left")
    return joined.withColumn("match", decided(F.col("found"), F.col("mapped"), F.col("verified"), threshold)).select(*pairs.columns, "match")


def confusion(rows: DataFrame, by: str) -> DataFrame:
    """tp, fp, tn, fn, precision, recall and false positive rate by group; an empty ratio is 1, or 0 for the rate."""
    p, s = F.col("predicted"), F.col("expected")
    out = rows.groupBy(by).agg(
        F.count_if(p & s).alias("tp"), F.count_if(p & ~s).alias("fp"), F.count_if(~p & ~s).alias("tn"), F.count_if(~p & s).alias("fn")
    )
    ratio = lambda a, b, empty: F.when(b == 0, empty).otherwise(F.floor(a / b * 10000 + 0.5) / 10000)
    c = F.col
    return out.select(
        by, "tp", "fp", "tn", "fn", ratio(c("tp"), c("tp") + c("fp"), 1.0).alias("precision"), ratio(c("tp"), c("tp") + c("fn"), 1.0).alias("recall"),
        ratio(c("fp"), c("fp") + c("tn"), 0.0).alias("fpr"),
    )


def upc_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left_id, right_id) whose barcodes (id, upc) are equal or one ends in the other, the shorter of 8 digits or more; an equi-join on the last 8."""
    tail = lambda d, p: d.where("length(upc) >= 8").select(F.col("id").alias(f"{p}_id"), F.col("upc").alias(f"{p}_upc"), F.right("upc", F.lit(8)).alias("tail"))
    ends = F.col("left_upc").endswith(F.col("right_upc")) | F.col("right_upc").endswith(F.col("left_upc"))
    return tail(left, "left").join(tail(right, "right"), "tail").where(ends).select("left_id", "right_id")


def skus_equivalent(a: Column, b: Column) -> Column:
    """Equal, or numbers of the same length, six digits or more, that differ by one."""
    number = r"^\d{6,}$"
    near = F.abs(a.try_cast("decimal(38,0)") - b.try_cast("decimal(38,0)")) == 1
    return F.coalesce((a == b) | (a.rlike(number) & b.rlike(number) & (F.length(a) == F.length(b)) & near), F.lit(False))


def off_by_one_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left_id, right_id) of ids, as text, that skus_equivalent links: an equi-join on three aliases."""
    n = F.col("id").try_cast("decimal(38,0)")
    wide = F.length("id")
    near = F.array(F.col("id"), *[F.lpad((n + d).cast("decimal(38,0)").cast("string"), wide, F.lit("0")) for d in (-1, 1)])
    aliases = left.select(F.col("id").alias("left_id"), F.explode(F.array_distinct(F.when(F.col("id").rlike(r"^\d{6,}$"), near).otherwise(F.array("id")))).alias("right_id"))
    joined = aliases.join(right.select(F.col("id").alias("right_id")), "right_id")
    return joined.where(skus_equivalent(F.col("left_id"), F.col("right_id"))).select("left_id", "right_id")
