"""Secret scan: candidates by pattern, false positives removed by a random forest, DataFrame operations only.

Candidates are runs of at least SHORTEST characters of [A-Za-z0-9+/_-] with the = that pad them; where a
secret's name and an assignment stand before them, all values: what stands between quotes, or up to
white space or a separator, of SHORT characters or more; and private keys in armour, from their first line
to the last of the lines of 16 characters or more below it. One split of a text by the pattern gives what stands before and
after each candidate; the forest removes the false ones. Features of a candidate: length,
shares of digits, capitals, small letters and other signs, changes of character class between
neighbours, number of different characters, coverage by dictionary words, signs of a path or address
in it and just before it, words that name a secret, or a digest, number or placeholder, around it, and
the sum of the neighbouring words' log odds, learned from the findings (the WORDS most frequent of them).

The forest is trained on labelled findings (candidate, before, after, label). `labelled_findings`
makes the default set, from rules for how keys and look-alikes are written; any other may be given, of
any size. The rules share word lists with the features, so accuracy on such findings says little; the
tests hold the scan against lines written by hand.

Cases: null and empty texts have no candidates; repeated rows are reported each; starts count
characters from 0; a null key is reported as null; empty tables give an empty result; without both
labels among the findings every candidate is reported as a secret; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import query, read, table

SHORTEST = 16
SHORT = 4
AROUND = 48
TREES, DEPTH, FINDINGS, WORDS = 40, 8, 12000, 300
# fixed values: common words and name parts found in identifiers
DICTIONARY = (
    "about access account after again agent also and any app base before build cache call case check class client code config "
    "content count create data date default delete device document download email error event example false field file filter "
    "first folder for from function group handler have header home host image import index info input item key label language "
    "last layer length level library license line link list local lock log main make manager map match message method mode model "
    "module month name network new node not number object option order output page param part password path photo place plan "
    "post price private process product profile project public query read record report request response result return role "
    "row run sample search section security select send server service session set setting shop size source start state status "
    "step store string style system table task test text that the this time title token true type update upload user value "
    "version video view was week window with word work write year"
).split()
SYLLABLES = "tion ment ness able ing ung lich keit heit schaft elle ique ado mente cion ver be ge ent er re in ant al ou est zu ei sch ter ly ful".split()
NAMES = r"(?i)(secret|token|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|auth)"
# a value that a secret's name and an assignment stand before, quoted or bare; Java's look-behind has to be bounded
ASSIGNED = r"(?<=%s[A-Za-z0-9_-]{0,16}[\"']?\s{0,4}(?::=|=>|[=:])\s{0,4}" % NAMES
_LAST = r"(?<=[=:>]\s{0,4}[\"']?)"  # the cheap part of ASSIGNED, tried first
VALUE = r"%s(?:%s\")[^\"\s]{%d,}(?=\")|%s')[^'\s]{%d,}(?=')|%s)[^\s\"'<>(){}\[\],;=:][^\s\"'<>(){}\[\],;]{%d,})" % (_LAST, ASSIGNED, SHORT, ASSIGNED, SHORT, ASSIGNED, SHORT - 1)
ARMOUR = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:\s+[A-Za-z0-9+/=]{16,})*+"
CANDIDATE = r"%s|%s|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?" % (VALUE, ARMOUR, SHORTEST)
LOOKALIKE = r"(?i)(commit|sha-?\d*|md5|digest|checksum|hash|uuid|guid|version|build|isbn|phone|tel|card|account|invoice|order|example|sample|dummy|placeholder|revision|blob|etag)"
CONTEXT = ("name_before", "assigned", "quoted", "alike_before", "path_before", "alike_after", "words")
SHAPE = ("length", "digits", "capitals", "small", "signs", "changes", "different", "covered", "slashes", "hex", "dashes", "ending", "issuer")


def _around() -> Column:
    """The different words next to a candidate."""
    return F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", "before", "after")), "[^a-z]+"), lambda w: w != ""))


def odds(findings: DataFrame) -> dict[str, float]:
    """Log odds of a secret beside each of the WORDS most frequent neighbouring words of labelled findings."""
    total = {r["label"]: r["n"] for r in findings.groupBy("label").agg(F.count("*").alias("n")).collect()}
    words = findings.select("label", F.explode(_around()).alias("word")).groupBy("word").agg(F.count_if(F.col("label") == 1).alias("yes"), F.count_if(F.col("label") == 0).alias("no"))
    best = words.filter("yes + no >= 5").orderBy(F.desc(F.expr("yes + no")), "word").limit(WORDS).collect()
    yes, no = total.get(1.0, 0) + 2, total.get(0.0, 0) + 2
    return {r["word"]: math.log((r["yes"] + 1) / yes) - math.log((r["no"] + 1) / no) for r in best}


def features(df: DataFrame, words: dict[str, float]) -> DataFrame:
    """`df` (candidate, before, after) with the columns of SHAPE and CONTEXT; `words` are the neighbours' log odds."""
    known = F.create_map(*(F.lit(x) for kv in words.items() for x in kv)) if words else None
    near = F.aggregate(_around(), F.lit(0.0), lambda a, w: a + F.coalesce(F.element_at(known, w), F.lit(0.0))) if words else F.lit(0.0)
    c, n = F.col("candidate"), F.char_length("candidate").cast("double")
    share = lambda drop: 1 - F.char_length(F.regexp_replace(c, drop, "")) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]+", "\u0001"), "[A-Z]+", "\u0002"), "[a-z]+", "\u0003"), "[^A-Za-z0-9\u0001-\u0003]+", "\u0004")
    flag = lambda x: x.cast("double")
    return df.withColumns(
        {
            "length": n,
            "digits": share("[0-9]"),
            "capitals": share("[A-Z]"),
            "small": share("[a-z]"),
            "signs": share("[^A-Za-z0-9]"),
            "changes": (F.char_length(kinds) - 1) / n,
            "different": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0)),
            "covered": 1 - F.char_length(F.regexp_replace(F.lower(c), "(?:" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")", "")) / n,
            "slashes": F.char_length(F.regexp_replace(c, "[^/]", "")).cast("double"),
            "hex": flag(c.rlike("^[0-9a-f]+$")),
            "dashes": F.char_length(F.regexp_replace(c, "[^-]", "")).cast("double"),
            "ending": flag(c.rlike("=$")),
            "issuer": flag(c.rlike("^(-----BEGIN|AKIA|ASIA|gh[opsu]_|sk_live_|sk-|xox[abp]-|glpat-|AIza)")),
            "name_before": flag(F.col("before").rlike(NAMES + r"[^A-Za-z0-9]{0,6}$")),
            "assigned": flag(F.col("before").rlike(r"[=:]\s*[\"']?$")),
            "quoted": flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")),
            "alike_before": flag(F.col("before").rlike(LOOKALIKE)),
            "path_before": flag(F.col("before").rlike(r"(://\S*|[/\\.@#])$")),
            "words": near,
            "alike_after": flag(F.col("after").rlike(r"^[\w.]*[/\\.@]|^\.\w")),
        }
    )


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(candidate, before, after, label): keys as they are written in text and code, and look-alikes."""
    h = lambda k: F.sha2(F.concat(F.lit(k), F.col("id").cast("string")).cast("binary"), 256)
    pick = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(xs))) + 1).cast("int"))
    b64 = F.regexp_replace(F.base64(F.unhex(h("b"))), r"\s", "")
    digits = F.translate(h("d"), "abcdef", "012345")
    lead = pick("l", ["", "then the ", "set ", "of and with ", "in this file, ", "| thanor | ", "export ", "de la "])
    name = pick("n", ["token", "secret", "api_key", "API_KEY", "password", "access_key", "auth_token", "client_secret", "private-key", "credential", "Bearer"])
    sign = pick("s", [' = "', '="', "=", ": ", ': "', " = '", " "])
    tail = pick("t", ['"', '" the', "'", " ", ";", "", '", and'])
    alike = pick("a", ["commit ", "sha256: ", "md5 ", "checksum = ", "revision ", "uuid: ", "build ", "hash: ", "blob ", "version ", "etag: "])
    number = pick("c", ["card ", "phone ", "order ", "account no. ", "", "the ", "isbn ", "in the ", "on "])
    join = pick("j", ["_", "-", "/"])
    words = F.concat(pick("w1", DICTIONARY), join, pick("w2", DICTIONARY), join, pick("w3", DICTIONARY), join, F.substring(digits, 1, 3))
    secret = [
        (F.substring(h("x"), 1, 40), F.concat(lead, name, sign)),
        (F.substring(h("x"), 1, 32), F.concat(lead, name, sign)),
        (F.substring(b64, 1, 40), F.concat(lead, name, sign)),
        (b64, F.concat(lead, name, sign)),
        (F.concat(pick("p", ["ghp_", "sk_live_", "AKIA", "xoxb-", "glpat-"]), F.regexp_replace(F.substring(b64, 1, 30), "[+/=]", "a")), F.concat(lead, pick("m", ["", "key ", "use ", "= ", '"']))),
    ]
    other = [
        (F.substring(h("y"), 1, 40), F.concat(lead, alike)),
        (F.concat_ws("-", *(F.substring(h("u"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.concat(lead, pick("i", ["uuid: ", "id ", "/", "guid = "]))),
        (F.substring(digits, 1, 16), F.concat(lead, number)),
        (F.concat(words, F.lit("item")), F.concat(lead, pick("o", ["", "/", "https://example.com/", "see ", "class "]))),
        (F.concat(F.lit("2021-03-"), F.substring(digits, 1, 2), F.lit("T10-20-30-"), F.substring(digits, 3, 4)), F.concat(lead, pick("q", ["date ", "at ", "log-"]))),
    ]
    # values after a name and an assignment: passwords, keys without digits or with other signs; and words, variables and placeholders
    at = F.concat(lead, pick("n", ["token", "secret", "api_key", "API_KEY", "password", "passwd", "pwd", "auth_token", "client_secret", "credential"]), pick("v", [' = "', '="', "=", ": ", ': "', " = '", " = "]))
    letters = F.regexp_replace(b64, "[^A-Za-z]", "")
    mixed = F.concat(F.initcap(pick("w1", DICTIONARY)), pick("g", ["!", "&", "$", "@", "#", "%", "?", "", "_"]), F.substring(digits, 1, 3), pick("g2", ["!", "&", "xY", "", "zq", "$"]), F.initcap(pick("w2", DICTIONARY)), F.substring(digits, 5, 2))
    secret += [
        (F.substring(letters, 1, 24), at),
        (mixed, at),
        (F.concat(F.substring(b64, 3, 5), pick("g", ["!", "&", "$", "@", "#", "%", "?", "^", "*"]), F.substring(b64, 9, 6), pick("g2", ["!", "&", "~", "", ".", "$"])), at),
        (F.concat(pick("w1", DICTIONARY), F.substring(digits, 1, 2), F.initcap(pick("w2", DICTIONARY)), F.substring(digits, 4, 1)), at),
        (F.concat(F.lit("AKIA"), F.translate(F.upper(F.substring(h("x"), 1, 16)), "0123456789", "GHKMQRTVXZ")), F.concat(lead, pick("m", ["", "key ", "use ", "= ", '"']))),
    ]
    line = lambda k: F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(h(k), h(k + "2")))), r"\s", ""), 1, 64)
    armour = F.concat(F.lit("-----BEGIN "), pick("k1", ["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]), F.lit("PRIVATE KEY-----"))
    secret += [(F.when(F.pmod(F.xxhash64("id"), F.lit(4)) == 0, armour).otherwise(F.concat(armour, F.lit("\n"), line("p"), F.lit("\n"), line("q"))), F.concat(lead, pick("k2", ["", "\n", "key: ", ' = "'])))]
    dotted = pick("j2", [".", "_", "->", "."])
    other += [
        (pick("w1", DICTIONARY), at),
        (F.concat(pick("w1", DICTIONARY), dotted, pick("w2", DICTIONARY)), at),
        (F.concat(pick("y1", ["your_", "my-", "the_", "<your-", "${", "$", "example_", "process.env.", "os.environ."]), pick("w1", DICTIONARY), join, pick("w2", DICTIONARY)), at),
        (pick("y2", ["None", "null", "true", "false", "********", "xxxxxxxx", "changeme", "undefined", "required", "string", "String", "self.token", "optional", "<password>"]), at),
        (F.concat(pick("w1", DICTIONARY), join, pick("w2", DICTIONARY), join, pick("w3", DICTIONARY), pick("y3", ["", "s", "ing", "er"])), F.concat(lead, pick("o", ["", "/", "https://example.com/", "see ", "class "]))),
        (F.concat(F.repeat(pick("y4", ["-", "=", "_", "*"]), 20), F.lit("=")), lead),
        (F.concat(pick("w1", DICTIONARY), F.initcap(pick("w2", DICTIONARY)), F.initcap(pick("w3", DICTIONARY)), F.initcap(pick("w4", DICTIONARY))), F.concat(lead, pick("o", ["", "the ", "def ", "see ", "class "]))),
        (F.concat(pick("w1", DICTIONARY), pick("w2", DICTIONARY), pick("w3", DICTIONARY), pick("w4", DICTIONARY)), F.concat(lead, pick("o", ["", "the ", "a ", "see ", "of "]))),
        *((put(F.concat(*(pick(f"z{i}", SYLLABLES) for i in range(7)))), F.concat(lead, pick("o2", ["", "the ", "a ", "und ", "of ", "\n", ". "]))) for put in (F.lower, F.initcap, F.upper)),
    ]
    each = len(secret) + len(other)
    kind = F.pmod("id", F.lit(each))
    both = [*((c, b, 1.0) for c, b in secret), *((c, b, 0.0) for c, b in other)]
    cand = before = label = F.lit(None)
    for i, (c, b, y) in enumerate(both):
        cand, before, label = F.when(kind == i, c).otherwise(cand), F.when(kind == i, b).otherwise(before), F.when(kind == i, y).otherwise(label)
    return spark.range(0, n, 1, 1).select(cand.alias("candidate"), before.alias("before"), tail.alias("after"), label.cast("double").alias("label"))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, candidate, before, after) of every candidate of whole texts."""
    t = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_t"))
    t = t.withColumn("_found", F.regexp_extract_all("_t", F.lit(CANDIDATE), F.lit(0))).filter(F.size("_found") > 0)
    t = t.withColumn("_rest", F.split("_t", CANDIDATE, -1)).withColumn("_row", F.xxhash64("doc_id", "_t", F.monotonically_increasing_id()))
    after = F.transform(F.slice("_rest", 2, F.size("_found")), lambda x: F.substring(x, 1, AROUND))
    before = F.transform(F.slice("_rest", 1, F.size("_found")), lambda x: F.struct(F.when(F.char_length(x) > AROUND, F.substring(x, -AROUND, AROUND)).otherwise(x).alias("text"), F.char_length(x).cast("long").alias("n")))
    rows = t.select("doc_id", "_row", F.posexplode(F.arrays_zip(F.col("_found").alias("c"), before.alias("b"), after.alias("a"))).alias("pos", "x"))
    rows = rows.select("doc_id", "_row", "pos", F.col("x.c").alias("candidate"), F.col("x.b.text").alias("before"), F.col("x.b.n").alias("_gap"), F.col("x.a").alias("after"))
    rows = table(rows, "candidates")
    sofar = Window.partitionBy("_row").orderBy("pos")
    start = F.sum(F.col("_gap") + F.char_length("candidate")).over(sofar) - F.char_length("candidate")
    return rows.select("doc_id", start.alias("start"), "candidate", "before", "after")


def forest(findings: DataFrame):
    """The forest of labelled findings and the neighbouring words' odds; None where one of the labels is missing."""
    labelled = findings.filter("candidate is not null and label is not null").select("candidate", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), "label")
    if labelled.select("label").distinct().count() < 2:
        return None
    words = odds(labelled)
    ready = VectorAssembler(inputCols=[*SHAPE, *CONTEXT], outputCol="features").transform(features(labelled, words)).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="sqrt").fit(ready), words


def scan(docs: DataFrame, findings: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, n_chars, candidate, probability and is_secret of every candidate."""
    model = forest(labelled_findings(docs.sparkSession) if findings is None else findings)
    found = candidates(docs, key, text)
    p: Column = F.lit(1.0)
    if model is not None:
        trees, words = model
        found = trees.transform(VectorAssembler(inputCols=[*SHAPE, *CONTEXT], outputCol="features").transform(features(found, words)))
        p = vector_to_array("probability")[1]
    return found.select("doc_id", "start", F.char_length("candidate").cast("long").alias("n_chars"), "candidate", F.round(p, 6).alias("probability"), (p >= 0.5).alias("is_secret"))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
