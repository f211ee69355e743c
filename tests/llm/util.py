"""Small documents with every hard case: nulls, empty and blank texts, repeats, copies, near copies, one long text."""

import random

WORDS = {
    "en": "the of and to in is that for with are this from house river stone winter green walking thinking people water morning".split(),
    "de": "der die das und nicht ist mit auf für eine werden über können häuser straße schön zwischen mädchen größe während immer".split(),
    "fr": "le la les des et est dans pour une avec être été forêt où garçon déjà très même après château élève toujours rivière".split(),
}
NASTY = ["idiot", "scum", "moron", "loser", "pathetic"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def documents(spark, n=90, seed=3, extra=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        rows.append([i, prose(rng, lang, rng.randint(8, 60)), lang])
    for i in range(0, n, 10):  # copies and near copies, in other case and spacing
        words = rows[i][1].split()
        words[len(words) // 2] = "changed"
        rows.append([1000 + i, " ".join(words), rows[i][2]])
        rows.append([2000 + i, "  " + rows[i][1].upper().replace(" ", "\n\t") + " ", rows[i][2]])
    if extra:
        rows += [[3000, None, "en"], [3001, "", "en"], [3002, " \n\t", None], [3003, "one", None], [3004, "two words", None], [3005, "!!! 123 ???", None], [None, "a row without id " * 3, None], [3006, prose(rng, "de", 6000), "de"]]
        rows.append(list(rows[5]))
    return spark.createDataFrame([(d, t, l, f"src{(d or 0) % 4}", len(t or "")) for d, t, l in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """The same documents with more columns, of names that the operators use inside."""
    from pyspark.sql import functions as F

    more = {c: F.lit(7) for c in ("key", "n", "part", "score", "label", "ids", "piece", "node", "column", "toxic", "held", "length")}
    return docs.withColumns(more)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
