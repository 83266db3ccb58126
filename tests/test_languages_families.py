"""Language tags and families from tables, case by case."""

from rankloom.operators import families, languages


def test_languages(spark):
    reference = spark.createDataFrame([("deu", "de", "deu", "ger", "German"), ("nds", None, "nds", "nds", "Low German"), ("fra", "fr", "fra", "fre", "French"), ("xxa", "fr", "", "", "Another"), ("aka", "ak", "aka", "aka", "Aka")], "iso3 string, part1 string, part2t string, part2b string, name string")
    special = spark.createDataFrame([("Multilingual", "mul", "Multiple"), ("fr", "zzz", "Special")], "tag string, iso3 string, name string")
    synonyms = spark.createDataFrame([("Teutonic", "German"), ("gaul", "fre"), ("old gaul", "nothing")], "alias string, target string")
    asked = {
        "multilingual": ("mul", "special"), "fr": ("zzz", "special"), "FR_ca": ("fra", "code"), "GER": ("deu", "code"), "de-AT": ("deu", "code"), " low   GERMAN ": ("nds", "name"), "Teutonic": ("deu", "synonym"), "gaul": ("fra", "synonym"),
        "the low german corpus": ("nds", "mention"), "a teutonic saga": ("deu", "mention"), "some gaul": (None, None), "old gaul": (None, None), "aka": ("aka", "code"), "an aka text": (None, None), "germans": (None, None), "": (None, None), "-": (None, None),
    }
    rows = [(k, t) for k, t in enumerate([*asked, None, "x " * 3000 + "german"])]
    got = {r["k"]: (r["iso3"], r["found_by"]) for r in languages.resolved(spark.createDataFrame(rows * 2, "k int, tag string"), "tag", reference, special, synonyms).collect()}
    assert got == dict(enumerate([*asked.values(), (None, None), ("deu", "mention")]))


def test_families(spark):
    models = [(1, "BERT", "tiny-bert base", ["x"]), (2, "other", "my Llama_2 chat", None), (3, None, "the llama 3", []), (4, "z", "gamma", ["Alpha beta", None]), (5, "z", "gamma", []), (6, "z", None, ["alpha"]), (7, None, None, None), (8, "z", "alpha", ["beta"])]
    df = spark.createDataFrame(models, "id int, kind string, name string, tags array<string>")
    hints = spark.createDataFrame([("bert", "b-sure", None, 0.9), ("Bert", "a-sure", "kid", 0.9), ("BERT", "unsure", None, 0.5)], "kind string, family string, child string, confidence double")
    patterns = spark.createDataFrame([("llama", "llama", None, 0.95), ("llama 2", "llama", "llama-2", 0.97)], "phrase string, family string, child string, confidence double")
    aliases = spark.createDataFrame([("tag", "alpha", "one", 0.3), ("tag", "beta", "two", 0.25), ("name", "gamma", "one", 0.1), ("kind", "z", "two", 0.1)], "field string, word string, family string, weight double")
    got = {r["id"]: tuple(r)[1:] for r in families.by_tables(df, hints, patterns, aliases).collect()}
    none = (families.UNCLEAR, None, 0.0, "none")
    assert got == {1: ("a-sure", "kid", 0.9, "hint"), 2: ("llama", "llama-2", 0.97, "pattern"), 3: ("llama", None, 0.95, "pattern"), 4: none, 5: none, 6: ("one", None, 0.8, "alias"), 7: none, 8: ("two", None, 0.8, "alias")}
    texts = spark.createDataFrame([(1, "An Image and text"), (2, "image image"), (3, None), (4, "")], "id int, text string")
    words = spark.createDataFrame([("image", "image"), ("Text", "text")], "word string, route string")
    assert {r["id"]: (r["route"], r["routes"]) for r in families.routed(texts, words).collect()} == {1: ("multimodal", ["image", "text"]), 2: ("image", ["image"]), 3: ("other", []), 4: ("other", [])}
