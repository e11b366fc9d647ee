"""Whether an offer is the fresh or frozen product itself: a title is explained word by word, and what is left decides.

Vocabularies are tables: sizes and forms, house brands (and growers, if given), words of processed goods. All words of an offer's title,
name, address and text are exploded once, joined with the vocabularies, and come back as counts by one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import units
from larder.operators.offers import name_has

#: Words of processed goods in the order in which they are named as a reason; fixed values.
JUNK = [
    "pop", "pops", "popsicle", "tea", "extract", "juice", "frozen", "ice cream", "candy", "stick", "balm", "drink", "soda", "yogurt", "cookie", "sauce", "jam", "pie", "soap",
    "cleaner", "concentrate", "syrup", "muffin", "bread", "smoothie", "gummy", "chocolate", "cake", "pastry", "snapple", "detox", "herbal", "seasoning", "spice", "zest", "peel",
    "faux", "book", "replica", "artificial", "leather", "honey", "curd", "dressing", "marinade", "glaze", "nectar", "lemonade", "candle", "lotion", "shampoo", "kefir", "bagel",
    "slush", "dessert", "milk", "roasted", "shortcake", "meringue", "waffle", "fillo", "phyllo", "tart", "bites", "artichoke", "cheese", "pepper", "spear", "spears", "cored",
    "oil", "loaf", "mochi", "turnover", "pickled", "pickle", "canned", "marinated", "grapes",
]
#: Shapes of fresh packs, which frozen goods do not have; fixed values.
FRESH_SHAPES = ["pint", "clamshell", "bunch", "bunched", "kefir"]
#: Words of house brands, and of sizes, forms and varieties; fixed values.
HOUSE = [
    "no", "name", "farmer", "farmers", "market", "your", "fresh", "great", "value", "pc", "president", "presidents", "choice", "compliments", "organics", "selection",
    "irresistibles", "marketside", "driscoll", "driscolls",
]
SIZES = [
    "bag", "bags", "pack", "packed", "lb", "lbs", "kg", "g", "oz", "ea", "each", "single", "singles", "sold", "bunch", "whole", "fresh", "imperfect", "naturally", "english",
    "seedless", "greenhouse", "red", "green", "yellow", "grape", "cherry", "bell", "sweet", "bosc", "bartlett", "anjou", "roma", "vine", "long", "sliced", "chopped", "cultivated",
    "wild", "large", "jumbo", "golden", "medium", "small", "extra", "organic", "pint", "clamshell", "count", "ct", "pk", "product", "produce", "on", "the", "and", "of", "in", "by",
    "with", "for", "from",
]
SIZE_WORD = r"^\d+(\.\d+)?(lb|lbs|kg|g|oz|ml|l|ct|pk|ea)$"
#: Most unexplained words of a title or name, and of an address; fixed values.
TITLE_WORDS, SLUG_WORDS = 2, 1
REASONS = ["impostor", "too_large", "filter", "warehouse_impostor", "warehouse_too_large", "no_package", "address", "title"]


def vocabulary(spark: SparkSession) -> DataFrame:
    """(kind, word, ord) of the built-in vocabularies: junk, shape, house and size."""
    rows = [(kind, w, i) for kind, words in (("junk", JUNK), ("shape", FRESH_SHAPES), ("house", HOUSE), ("size", SIZES)) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "kind string, word string, ord int")


def words(text: Column) -> Column:
    """Words of two characters or more that are no numbers, repeats kept."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "['’]", "")
    return F.filter(F.split(plain, "[^a-z0-9]+"), lambda t: (F.length(t) > 1) & ~t.rlike(r"^\d+$"))


def stemmed(t: Column) -> Column:
    return (
        F.when(t.endswith("ies") & (F.length(t) > 4), F.regexp_replace(t, "ies$", "y")).when(t.endswith("oes") & (F.length(t) > 4), F.regexp_replace(t, "es$", ""))
        .when(t.endswith("s") & ~t.endswith("ss") & (F.length(t) > 3), F.regexp_replace(t, "s$", "")).otherwise(t)
    )


def title_view(name: Column) -> Column:
    """A warehouse title as a shelf would print it."""
    out = F.regexp_replace(name, r"(?i)^(fruits|vegetables)\s*[-–]\s*", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)\bcase\b", " "), r"(?i)\bper\s*kg\b", "1 kg")
    return F.regexp_replace(F.regexp_replace(out, r"(?i)\bpints?\b", "pack"), r"(?i)\b\d+\s*x\s*\d+(?:\.\d+)?\b", " ")


def slug_text(url: Column) -> Column:
    """The part of an address that names the product; the whole of what is no address."""
    parts = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda p: ~p.isin("", "en", "p", "ip") & ~p.rlike(r"^\d") & (F.length(p) > 2))
    return F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.coalesce(F.get(parts, F.lit(0)), F.lit(""))).otherwise(F.coalesce(url, F.lit("")))


def product_reason(offers: DataFrame, items: DataFrame, vocabularies: DataFrame | None = None) -> DataFrame:
    """(item, offer_id, reason, word): why an offer is not the product, the first of REASONS that applies, null if it is; word is the impostor's.

    items: item, category (produce or frozen), must_any and must_all (arrays of words), rejects (array), each_grams, max_kg, pint_kg. offers: item, offer_id, name,
    brand, size, parsed_kg, url, filter_reason (of the shelf view). vocabularies: kind (junk, shape, house, size or grower), word, ord; null for the built-in ones.
    Words that the item's own words hold are never junk. Null texts are empty, repeated rows of an offer are one, other columns are
    ignored; offers of unknown items have no row. The vocabularies are broadcast only if Spark finds them small.
    """
    spark = offers.sparkSession
    vocab = vocabularies if vocabularies is not None else vocabulary(spark)
    none = F.expr("cast(array() as array<string>)")
    arrays = [F.coalesce(c, none).alias(c) for c in ("must_any", "must_all", "rejects")]
    settings = items.select("item", F.coalesce("category", F.lit("")).alias("category"), *arrays, "each_grams", "max_kg", "pint_kg")
    own = F.concat("must_any", "must_all")
    cores = F.array_distinct(F.filter(F.flatten(F.transform(own, words)), lambda t: t != "frozen"))
    blob = F.lower(F.concat_ws(" ", F.col("item").cast("string"), "category", "must_any", "must_all"))
    settings = settings.withColumns({"cores": F.array_distinct(F.flatten(F.transform(cores, lambda t: F.array(stemmed(t), stemmed(stemmed(t)))))), "blob": blob})
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = offers.dropDuplicates(["item", "offer_id"]).select("item", "offer_id", "name", "brand", "size", "parsed_kg", "url", "filter_reason")
    rows = one.join(settings, "item")
    farm = r"(?i)^(fruits|vegetables)$"
    house = F.coalesce(F.col("brand").rlike(farm), F.lit(False))
    from_warehouse = house | F.coalesce(F.col("name").rlike(r"(?i)^(fruits|vegetables)\s*[-–]"), F.lit(False))
    rows = rows.withColumns({"view": title_view(text("name")), "view_brand": F.when(house, "").otherwise(text("brand")), "view_url": F.when(from_warehouse, "").otherwise(text("url"))})
    rows = rows.withColumns({"hay": F.concat_ws(" ", text("brand"), text("name"), text("url")), "view_hay": F.concat_ws(" ", "view_brand", "view", "view_url"), "slug": slug_text(F.col("view_url"))})

    # every word once, with the field it stands in
    raw = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != ""))
    tagged = lambda field, ws: F.transform(ws, lambda t: F.struct(F.lit(field).alias("field"), t.alias("t")))
    fields = F.concat(
        tagged("title", words(F.concat_ws(" ", "view_brand", "view"))), tagged("name", words(F.col("view"))), tagged("slug", words(F.col("slug"))), tagged("hay", raw(F.col("hay"))),
        tagged("view_hay", raw(F.col("view_hay"))), tagged("slug_hay", raw(F.array_join(words(F.col("slug")), " "))),
    )
    frozen = F.col("category") == "frozen"
    said = rows.select("item", "offer_id", "cores", "blob", "rejects", frozen.alias("frozen"), F.explode_outer(fields).alias("w")).select("*", "w.*").drop("w")
    said = said.withColumn("stem", stemmed(F.col("t")))
    known = vocab.where("kind in ('house', 'size', 'grower')").select(F.explode(F.array("word", stemmed(F.col("word")))).alias("stem")).distinct().withColumn("known", F.lit(True))
    single = vocab.where("kind in ('junk', 'shape') and not contains(word, ' ')")
    bad = single.select(F.explode(F.array("word", F.concat("word", F.lit("s")), F.concat("word", F.lit("es")))).alias("t"), "kind", "word", "ord").distinct()
    said = said.join(known, "stem", "left").join(bad.groupBy("t").agg(F.collect_set(F.struct("ord", "kind", "word")).alias("bad")), "t", "left")
    allowed = lambda w: (
        name_has(F.col("blob"), w) | ((w == "frozen") & F.col("frozen")) | ((w == "juice") & F.lower(F.col("item").cast("string")).rlike("juice|realemon"))
    )
    hits = F.filter(F.coalesce("bad", F.expr("cast(array() as array<struct<ord:int,kind:string,word:string>>)")), lambda b: F.when(b["kind"] == "shape", F.col("frozen")).otherwise(~allowed(b["word"])))
    first = F.array_min(F.transform(hits, lambda b: F.struct((b["kind"] == "shape").alias("last"), b["ord"].alias("ord"), b["word"].alias("word"))))
    extra = F.get(F.filter("rejects", lambda w: ~w.contains(" ") & ~allowed(w) & name_has(F.col("t"), w)), F.lit(0))
    junk = F.exists(hits, lambda b: b["kind"] == "junk")
    core = F.array_contains("cores", F.col("t")) | F.array_contains("cores", F.col("stem"))
    left = ~core & F.col("known").isNull() & ~F.col("t").rlike(SIZE_WORD)
    said = said.withColumns({"first": first, "extra": extra, "junk": junk, "core": core, "left": left})
    at = lambda f: F.col("field") == f
    number = lambda c: F.count(F.when(c, 1))
    facts = said.groupBy("item", "offer_id").agg(
        *[number(at(f) & F.col("left")).alias(f"{f}_left") for f in ("title", "name", "slug")], *[number(at(f) & F.col("left") & F.col("junk")).alias(f"{f}_junk") for f in ("title", "name", "slug")],
        number(at("name") & F.col("core")).alias("name_core"), number(at("name")).alias("name_words"), number(at("slug")).alias("slug_words"),
        *[F.min(F.when(at(f), F.col("first"))).alias(f"first_{f}") for f in ("hay", "view_hay", "slug_hay")],
        *[F.min(F.when(at(f), F.col("extra"))).alias(f"extra_{f}") for f in ("hay", "view_hay", "slug_hay")],
    )
    rows = rows.join(facts, ["item", "offer_id"])

    # phrases are looked for in the text: those of the built-in junk and of the item
    phrases = vocab.where("kind = 'junk' and contains(word, ' ')").agg(F.sort_array(F.collect_list(F.struct("ord", "word"))).alias("p")).first().p
    default = F.array(*[F.struct(F.lit(False).alias("last"), F.lit(p.ord).alias("ord"), F.lit(p.word).alias("word")) for p in phrases]) if phrases else None

    def impostor(field: str, hay: Column) -> Column:
        ways = [F.col(f"first_{field}")]
        if default is not None:
            ways.append(F.array_min(F.filter(default, lambda p: F.lower(hay).contains(p["word"]) & ~name_has(F.col("blob"), p["word"]))))
        own_phrase = F.get(F.filter("rejects", lambda w: w.contains(" ") & ~name_has(F.col("blob"), w) & name_has(hay, w)), F.lit(0))
        least = F.least(*ways) if len(ways) > 1 else ways[0]
        plain = F.when(~F.coalesce(least["last"], F.lit(True)), least["word"])
        return F.coalesce(plain, F.col(f"extra_{field}"), own_phrase, least["word"])

    frozen = F.col("category") == "frozen"
    printed = lambda c: units.pack_mass_kg(c, F.lit(None).cast("double"))

    def mass(name: Column) -> Column:
        both = F.concat_ws(" ", F.coalesce("size", F.lit("")), name)
        solid = F.when(F.col("category") == "produce", F.regexp_replace(both, r"(?i)\b\d+(?:\.\d+)?\s*l\b", " ")).otherwise(both)
        each = F.when(F.col("each_grams") > 0, F.col("each_grams") / 1000)
        return F.coalesce(
            printed(solid), F.when(both.rlike(r"(?i)\bpints?\b"), F.col("pint_kg")), F.when(sold_by_piece(both), each),
            F.when((F.col("name_words") > 0) & (F.col("name_left") == 0), each), F.when(F.col("category") != "produce", units.pack_mass_kg(both, F.col("parsed_kg"))),
        )

    def sold_by_piece(both: Column) -> Column:
        return both.rlike(r"(?i)sold in singles|\b1\s*ea\b")

    view_both = F.concat_ws(" ", F.coalesce("size", F.lit("")), "view")
    packed = units.pack_mass_kg(view_both, F.col("parsed_kg")).isNotNull()
    shape = packed | sold_by_piece(view_both) | ((F.col("name_core") > 0) & (F.col("name_junk") == 0) & (F.col("name_left") <= TITLE_WORDS))
    slug = (F.col("slug_words") == 0) | (impostor("slug_hay", F.array_join(words(F.col("slug")), " ")).isNull() & (F.col("slug_junk") == 0) & (packed | (F.col("slug_left") <= SLUG_WORDS)))
    title = (F.col("title_junk") == 0) & (packed | (F.col("title_left") <= TITLE_WORDS))
    raw_word, view_word = impostor("hay", F.col("hay")), impostor("view_hay", F.col("view_hay"))
    rows = rows.withColumns({"raw_word": raw_word, "view_word": view_word, "raw_kg": mass(text("name")), "view_kg": mass(F.col("view"))})
    rules = [
        F.col("raw_word").isNotNull(), F.col("raw_kg") > F.col("max_kg"), F.col("filter_reason").isNotNull(), F.col("view_word").isNotNull(), F.col("view_kg") > F.col("max_kg"),
        ~frozen & ~shape, ~frozen & ~slug, ~frozen & ~title,
    ]
    reason = F.coalesce(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in zip(REASONS, rules)])
    word = F.when(F.col("reason") == "impostor", F.col("raw_word")).when(F.col("reason") == "warehouse_impostor", F.col("view_word"))
    return rows.withColumn("reason", reason).select("item", "offer_id", "reason", word.alias("word"))
