"""Secret scan with a random forest that removes false positives; DataFrame functions only.

A pattern finds candidates in whole texts: values behind a key word or an assignment to one, passwords in
addresses, private keys as one span, and long runs with a digit anywhere.  Each becomes a row of numbers:
length, shares and transitions of character classes, common letter pairs, dictionary coverage, path words
and words beside it.  The dictionary are the fixed words below and every word that two different texts of
the corpus hold behind white space.  A random forest trained on labelled findings decides which
candidates are secrets.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepforge.functions.frame import lookup

from .quality import text_key
from .storage import fits, free_names, stored

KEY_WORDS = r"(?:token|secret|passw|passphrase|pwd|api[_-]?key|access[_-]?key|auth(?!ors?\b)|credential|private|bearer|signing)"
_NAME = KEY_WORDS + r"[A-Za-z0-9_\-]{0,24}"
_SIGN = r"[:=]=?>?\s{0,3}(?:(?:bearer|basic)\s{1,2})?"
_RUN = r"[A-Za-z0-9+/_\-]"
# a short look-behind in front of each long one: only few places of a text are looked at closely
BLOCK = (r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----(?:[^-]*+-(?!----)){0,8}[^-]*+-----END [A-Z ]{0,32}PRIVATE KEY-----"
         r"|-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----(?:\s{0,4}[A-Za-z0-9+/=]{16,}+){0,200}+")
ADDRESS = r"(?<=:)(?<=://[^\s/@:]{0,64}:)[^\s/@]{3,}+(?=@)"
QUOTED = "|".join(rf"(?<={q})(?<=(?i:{_NAME}[\"']?\s{{0,3}}{_SIGN}){q})[^\s{q}]{{6,}}+(?={q})" for q in "\"'`")
ASSIGNED = rf"(?<=[:=>]\s{{0,3}}(?i:(?:bearer|basic)\s{{1,2}})?)(?<=(?i:{_NAME}[\"']?\s{{0,3}}{_SIGN}))(?!(?i:bearer|basic)\s)[^\s\"'`,;()\[\]{{}}<>&|:=]" + r"[^\s\"'`,;()\[\]{}<>&|]{4,}(?<![.:!?])[^\s\"'`,;()\[\]{}<>&|.:?]"
BEHIND = rf"(?<=\s)(?=[^\s0-9]{{0,24}}[0-9])(?<=(?i:{_NAME})\s(?i:is\s)?)" + r"[^\s\"'`,;()\[\]{}<>&|:=][^\s\"'`,;()\[\]{}<>|]{4,}[^\s\"'`,;()\[\]{}<>&|.:?]"
LONG = rf"(?<!{_RUN})(?=[A-Za-z+/_\-]*+[0-9]){_RUN}{{16,}}={{0,2}}"
NAMED = rf"(?<=[:=>\s\"'`])(?:{ADDRESS}|{QUOTED}|{ASSIGNED}|{BEHIND})|{BLOCK}"
CANDIDATE = f"{NAMED}|{LONG}"
BEFORE, AFTER = 48, 32    # characters of context
LABELLED_ROWS = 5_000     # findings of the corpus that the forest learns from
RULE_ROWS = 3_000         # labelled examples built from rules
WHOLE = 12                # from this length on a secret is masked wherever its document repeats it
TREES, DEPTH = 32, 8
# Words of the dictionary and letter pairs that are common in English.
DICTIONARY = ("the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who boy did its let put say she too use "
              "user name file path page item data test list view type code time year main home config setting profile image value number index table column server client request response "
              "session order invoice product version build report email account address message thread event module package release branch commit example sample default "
              "required optional string password secret token change placeholder expired missing invalid empty field service policy manager company header").split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()
OTHER_WORDS = r"(?i)(example|sample|dummy|placeholder|your|commit|sha\d|md5|checksum|hash|digest|uuid|guid|revision|build|isbn|order|invoice|tracking|request|session id|etag)"
WORD = r"(?<![^\s(])[a-z]{4,}+(?=[\s.,;:!?)]|$)(?<![:=>\"'`]\s{0,3}[a-z]{4,24})"
PART = "[A-Z]?[a-z]{3,}|[A-Z]{4,}"  # the words inside a value
FEATURES = ["length", "digits", "upper", "lower", "marks", "changes", "pairs", "distinct", "coverage", "hex", "block", "reference", "in_address", "test_path", "key_before", "key_near", "assigned", "quoted", "other_near"]


def candidates(documents: DataFrame, text: str = "text", path: str | None = "source") -> DataFrame:
    """(doc_id, text_key, path, k, start, value, before, after): every candidate of every whole text.

    ``k`` counts a text's candidates.  Starts are one running sum, kept as an array that is copied at each
    candidate (50,000 candidates in one text take about 40 seconds); the contexts reach over the candidate before.
    """
    where = F.col(path).cast("string") if path and path in documents.columns else F.lit("")
    rows = documents.select("doc_id", text_key(text).alias("text_key"), F.coalesce(where, F.lit("")).alias("path"), F.col(text).alias("text"))
    # a text without a named candidate has the long runs only; telling so is several times cheaper than the whole pattern
    everywhere = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    rows = rows.withColumn("found", F.when(F.col("text").rlike(NAMED), everywhere(CANDIDATE)).otherwise(everywhere(LONG))).where(F.size("found") > 0)
    rows = rows.withColumn("rest", F.split("text", CANDIDATE, -1))
    steps = F.zip_with(F.col("rest"), F.col("found"), lambda r, v: F.struct(F.length(r).alias("r"), F.coalesce(F.length(v), F.lit(0)).alias("v")))
    empty = F.array().cast("array<bigint>")
    # ends of the candidates so far
    ends = F.aggregate(steps, empty, lambda a, s: F.array_append(a, F.when(F.size(a) > 0, F.element_at(a, -1)).otherwise(F.lit(0)).cast("bigint") + s["r"] + s["v"]))
    rows = rows.withColumn("ends", ends)

    def one(value: Column, k: Column) -> Column:
        at = lambda name, i: F.coalesce(F.get(F.col(name), i), F.lit(""))
        before = F.concat(F.when(F.length(at("rest", k)) < BEFORE, F.concat(F.right(at("rest", k - 1), F.lit(BEFORE)), at("found", k - 1))).otherwise(""), at("rest", k))
        after = F.concat(at("rest", k + 1), F.when(F.length(at("rest", k + 1)) < AFTER, at("found", k + 1)).otherwise(""))
        return F.struct(k.alias("k"), (F.get(F.col("ends"), k) - F.length(value)).alias("start"), value.alias("value"), F.right(before, F.lit(BEFORE)).alias("before"), F.left(after, F.lit(AFTER)).alias("after"))

    return rows.select("doc_id", "text_key", "path", F.inline(F.transform("found", one)))


def known_words(documents: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """``word``: those of ``wanted`` (word) that two or more different texts hold as a word of their own, not behind a sign of assignment.

    Smallest and largest text hash of a word tell it, so a frequent word costs two numbers a task.
    """
    texts = documents.select(text_key(text).alias("text_key"), F.lower(F.col(text)).alias("text"))
    words = texts.select("text_key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word"))
    # beyond the bound words are counted before the join: no hot word reaches it
    if fits(wanted, 200_000):
        words = words.join(F.broadcast(wanted), "word", "left_semi")
    seen = words.groupBy("word").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a < b").select("word")
    return seen.join(wanted, "word", "left_semi")


def parts_of(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit(PART), F.lit(0)), F.lower)


def with_coverage(findings: DataFrame, documents: DataFrame | None, text: str = "text") -> DataFrame:
    """Adds ``coverage``: the share of a value's characters that stand in dictionary words."""
    low = F.lower("value")
    fixed = F.length(F.regexp_replace(low, "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w))), ""))
    if documents is None:
        return findings.withColumn("coverage", 1 - fixed / F.length("value"))
    # the fixed words leave the value first, what is left is looked up in the corpus
    left = F.regexp_replace("value", "(?i)(" + "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w))) + ")", " ")
    values = stored(findings.select(F.xxhash64("value").alias("v"), F.length("value").alias("n"), fixed.alias("left_n"), parts_of(left).alias("parts")).distinct(), "values")
    parts = values.select("v", F.explode("parts").alias("word"))
    wanted = stored(parts.select("word").distinct(), "wanted")
    known = stored(known_words(documents, wanted, text).withColumn("hit", F.lit(1)), "known")
    covered = lookup(parts, known, "word").where("hit = 1").groupBy("v").agg(F.sum(F.length("word")).alias("covered"))
    share = values.groupBy("v").agg(F.max("n").alias("n"), F.max("left_n").alias("left_n")).join(covered, "v", "left").select("v", (1 - (F.col("left_n") - F.coalesce("covered", F.lit(0))) / F.col("n")).alias("coverage"))
    return lookup(findings.withColumn("v", F.xxhash64("value")), stored(share, "coverage"), "v").drop("v")


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def with_features(findings: DataFrame) -> DataFrame:
    """The numbers of each finding with its ``coverage``, in double; null context counts as empty."""
    low = F.lower("value")
    before, after, path = (F.coalesce(F.col(c), F.lit("")) for c in ("before", "after", "path"))
    flag = lambda c: c.cast("double")
    change = r"(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    values = {
        "length": F.length("value"), "digits": _share("[0-9]"), "upper": _share("[A-Z]"), "lower": _share("[a-z]"), "marks": _share("[^A-Za-z0-9]"), "changes": _share(change),
        "pairs": F.regexp_count(low, F.lit("(?=" + "|".join(PAIRS) + ")")) / F.length("value"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"), "coverage": F.col("coverage"),
        "hex": flag(F.col("value").rlike("^([0-9a-f]+|[0-9A-F]+)$")), "block": flag(F.col("value").startswith("-----BEGIN")),
        "reference": flag(F.col("value").rlike(r"^[$%{<*]|[({]|^[a-z]+(\.[a-z_]+)+$")),
        "in_address": flag(before.rlike(r"://[^\s/@:]*:$")),
        "test_path": flag(path.rlike("(?i)(test|example|fixture|sample|mock|doc)")),
        "key_before": flag(before.rlike(f"(?i){_NAME}[^A-Za-z]{{0,8}}(bearer |basic |is )?[\"'`]?$")), "key_near": flag(before.rlike("(?i)" + KEY_WORDS)),
        "assigned": flag(before.rlike("[:=]>?\\s*(?i:bearer |basic )?[\"'`]?$")), "quoted": flag(before.rlike("[\"'`]$")), "other_near": flag(F.concat(before, F.lit(" "), after).rlike(OTHER_WORDS)),
    }
    return findings.withColumns({f"f_{k}": v.cast("double") for k, v in values.items()})


def rule_findings(spark: SparkSession, rows: int = RULE_ROWS) -> DataFrame:
    """Labelled examples built from rules: secrets in the places where they stand, and their usual look-alikes."""
    pick = lambda salt, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    digest, long = F.sha1(F.col("id").cast("string")), F.sha2(F.col("id").cast("string"), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(long)), "[+/=]", "x")
    letters = F.regexp_replace(F.base64(F.unhex(F.concat(long, F.sha2(long, 256)))), "[^A-Za-z]", "")
    digits = F.substring(F.translate(long, "abcdef", "012345"), 1, 16)
    word = lambda salt: pick(salt, [w for w in DICTIONARY if len(w) > 3])
    some = F.substring(digits, 3, 2)
    name = F.concat_ws("_", word(1), word(2), word(3), some)
    uuid = F.regexp_replace(F.substring(long, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    n = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(5)).cast("int")
    short = F.substring(mixed, 1, 8 + n)
    chosen = F.concat(F.when(n % 2 == 0, F.initcap(word(11))).otherwise(F.lower(F.substring(letters, 1, 6))), some, pick(12, ["!", "#", "$", "", "?x", "_", "@"]))
    shapes = [  # (value, secret, the words before)
        (digest, 1, "key"), (digest, 1, "key"), (F.upper(digest), 1, "key"), (F.substring(mixed, 1, 36), 1, "key"), (F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16))), 1, "key"),
        (chosen, 1, "key"), (short, 1, "key"), (F.substring(letters, 1, 24), 1, "key"), (F.when(n < 3, chosen).otherwise(short), 1, "address"),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), mixed, F.lit("\n"), F.reverse(mixed), F.lit("\n-----END RSA PRIVATE KEY-----")), 1, "plain"),
        (digits, 0, "plain"), (uuid, 0, "plain"), (name, 0, "plain"), (F.concat_ws("/", word(4), word(5), word(6), F.concat(word(7), some)), 0, "plain"), (digest, 0, "digest"), (digest, 0, "digest"),
        (word(8), 0, "key"), (F.concat_ws("_", word(8), word(9)), 0, "key"),
        (pick(13, ["${PASSWORD}", "os.environ.token", "config.auth.password", "<your-token>", "get_secret(name)", "********", "xxxxxxxx", "XXXXXXXXXXXX", "%(password)s"]), 0, "key"),
        (F.concat(word(9), F.lit("-"), word(6)), 0, "key"),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(shapes)))

    def by_kind(choose) -> Column:
        out = choose(shapes[-1])
        for i, shape in enumerate(shapes[:-1]):
            out = F.when(kind == i, choose(shape)).otherwise(out)
        return out

    place = {"key": pick(5, ['token = "', "api_key: ", "SECRET=", 'password = "', "auth token ", 'private_key = "', "access key ", "TOKEN = \"", "Bearer ", "password: ", "DB_PASSWORD=", "?api_key=", "pwd='", "Authorization: Bearer ", "token: ", "AWS_ACCESS_KEY_ID="]),
             "address": pick(14, ["postgres://bob:", "https://app:", "see mysql://root:", "amqp://svc_1:", "url = redis://:"]), "digest": pick(6, ["commit ", "sha1 ", "md5 checksum ", "file hash ", "revision "]),
             "plain": pick(7, ["the ", "order ", "see ", "in ", "id = ", "name: ", "and ", "call "])}
    after = F.when(by_kind(lambda s: F.lit(s[2] == "address")), pick(15, ["@db", "@db.host/x", "@10.0.0.1:5432"])).otherwise(pick(9, ['"', " and", ".", " of the", ";"]))
    path = pick(8, ["src0", "src/app", "config/prod", "notes", "web"])
    return spark.range(rows).select(by_kind(lambda s: s[0]).alias("value"), by_kind(lambda s: place[s[2]]).alias("before"), after.alias("after"), path.alias("path"), by_kind(lambda s: F.lit(float(s[1]))).alias("label"))


def corpus_findings(found: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """At most ``rows`` candidates of the corpus (by a hash) with a label that no feature holds.

    Formats of issuers are secrets.  Numbers with a card's check digit, UUIDs of a known version and
    time stamps are none, unless a key word is before them.
    """
    issued = F.col("value").rlike("^(AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35})$")
    number = F.regexp_replace("value", "-", "")
    public = (number.rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", number)) | F.lower("value").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$") | F.col("value").rlike("^(19|20)[0-9]{2}-[01][0-9]-[0-3][0-9][T_-][0-9]{2}")
    keyed = F.col("before").rlike("(?i)" + KEY_WORDS)
    label = F.when(issued, 1.0).when(public & ~keyed, 0.0)
    picked = found.withColumn("label", label).where("label IS NOT NULL").orderBy(F.xxhash64("value", "before", "start"), "value", "before", "start").limit(rows)
    return picked.select("value", "before", "after", "path", "label")


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> PipelineModel:
    """A random forest over findings with ``value, before, after, path, label`` (1 secret, 0 not), and ``coverage`` where known."""
    rows = labelled.where(F.col("label").isin(0, 1) & (F.length("value") > 0))
    rows = with_features(rows if "coverage" in rows.columns else with_coverage(rows, None))
    assemble = VectorAssembler(inputCols=[f"f_{c}" for c in FEATURES], outputCol="features")
    forest = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
    rows = assemble.transform(rows).select("features", "label")
    return PipelineModel([assemble, forest.fit(rows)])


def scan(documents: DataFrame, labelled: DataFrame | None = None, text: str = "text", path: str | None = "source", limit: float = 0.5) -> DataFrame:
    """(doc_id, text_key, k, start, length, value, score, is_secret) for every candidate.

    ``start`` counts characters from 0, ``k`` the candidates of a text.  ``labelled`` are findings with labels;
    without it the forest learns from rule-built examples and a bounded sample of the corpus's candidates
    whose form is settled.  Null and empty texts have no candidates, repeated rows bring theirs each, a null
    doc_id is kept, and columns beyond doc_id, text and path are not read.
    """
    found = stored(candidates(documents, text, path), "candidates")
    if labelled is None:
        labelled = corpus_findings(found)
    examples = rule_findings(documents.sparkSession).unionByName(labelled.select("value", "before", "after", "path", F.col("label").cast("double").alias("label")))
    rows = found.withColumn("label", F.lit(None).cast("double")).unionByName(examples, allowMissingColumns=True)
    rows = stored(with_coverage(rows, documents, text), "covered")
    model = train(rows.where("label IS NOT NULL"))
    scored = model.transform(with_features(rows.where("label IS NULL")))
    score = F.element_at(vector_to_array("probability"), 2)
    return scored.select("doc_id", "text_key", "k", "start", F.length("value").cast("bigint").alias("length"), "value", score.alias("score"), (score >= limit).alias("is_secret"))


def redact(documents: DataFrame, text: str = "text", path: str | None = "source", mask: str = "[SECRET]") -> DataFrame:
    """All documents, their secrets replaced by ``mask``; other columns are kept, n_chars follows the text.

    Secrets are masked where they stand; those of at least ``WHOLE`` characters wherever their document
    repeats them.  Null and empty texts stay as they are, repeated rows are masked alike, an empty table
    gives an empty one, and columns of any name are kept.
    """
    scanned = scan(documents, None, text, path)
    places = scanned.groupBy("doc_id", "text_key", "k").agg(F.max("is_secret").alias("hit"), F.first("value").alias("value"))
    doc, key, own, hits, values = free_names(documents, "s_doc", "s_key", "s_text", "s_hits", "s_values")
    longest = F.transform(F.sort_array(F.collect_set(F.when(F.col("hit") & (F.length("value") >= WHOLE), F.struct(F.length("value").alias("n"), "value"))), asc=False), lambda x: x["value"])
    lists = places.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "hit"))), lambda x: x["hit"]).alias(hits), longest.alias(values)).where(F.array_contains(hits, True))
    lists = stored(lists, "secrets")
    size = F.size(hits) + F.aggregate(values, F.lit(0), lambda s, v: s + F.length(v)) + 64
    small = lists.agg(F.coalesce(F.sum(size), F.lit(0))).head()[0] <= 64 << 20 and fits(lists, 500_000)
    joined = documents.withColumn(own, text_key(text)).join(F.broadcast(lists) if small else lists, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key)), "left")
    found = F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0))
    shown = F.zip_with(found, F.col(hits), lambda v, hit: F.when(hit, F.lit(mask)).otherwise(v))
    pieces = F.zip_with(F.split(F.col(text), CANDIDATE, -1), shown, lambda r, v: F.concat(r, F.coalesce(v, F.lit(""))))
    masked = F.when(F.col(hits).isNull(), F.col(text)).otherwise(F.aggregate(values, F.array_join(pieces, ""), lambda t, v: F.replace(t, v, F.lit(mask))))
    columns = [masked.alias(c) if c == text else F.when(F.col(hits).isNull(), F.col(c)).otherwise(F.length(masked)).cast(documents.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in documents.columns]
    return joined.select(*columns)
