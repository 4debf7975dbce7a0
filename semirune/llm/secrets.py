"""Secret scans: patterns propose candidates, a random forest removes false positives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import return_freed

#: A private key, up to its end or, where that is missing, as far as its lines go.
KEY = r"[A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
PEM = rf"-----BEGIN {KEY}(?:(?:[^-]|-(?!----(?:BEGIN|END) ))*+-----END {KEY}|(?:\s++[A-Za-z0-9+/=]{{40,}}+)++)"
#: A value set to a name such as token or password, which may go on: AWS_ACCESS_KEY_ID, secretValue, token2.
NAMED = r"(?i:token|secret|passwd|password|passphrase|pwd|api_?-?key|access_?-?key|auth)(?:[_-][A-Za-z0-9_-]{0,63}+|[A-Z][a-z][A-Za-z0-9_-]{0,62}+|[0-9]{1,3}+)?+[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"']{6,}+)"
#: How keys of well-known services begin.
PREFIXED = r"(?:A[KS]IA[A-Z2-7]{16}|gh[opsur]_[A-Za-z0-9]{20}|github_pat_[A-Za-z0-9_]{20}|glpat-[A-Za-z0-9_-]{16}|xox[abeprs]-[A-Za-z0-9-]{10}|sk-[A-Za-z0-9_-]{20})"
#: A run of key characters that has a digit, begins as such keys do, or is long and of both cases; not one that names what follows.
RUN = rf"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*+[0-9])|(?={PREFIXED})|(?=[a-z+/_-]*+[A-Z])(?=[A-Z+/_-]*+[a-z])(?=[A-Za-z+/_-]{{20}}))(?![A-Za-z0-9+/_-]*?{NAMED})[A-Za-z0-9+/_-]{{12,}}={{0,2}}"
CANDIDATE = f"{PEM}|{NAMED}|{RUN}"
CONTEXT = 48
THRESHOLD = 0.5
TREES, DEPTH = 25, 6
#: Labelled findings that the forest learns from, at most.
MAX_FINDINGS = 6000
SEED = 5

#: Words of code and prose that make a candidate an identifier or a path and not a secret.
DICTIONARY = "about account admin and api app array base block build byte cache call case class client code column config connect content context control count create data date default delete demo digest document dummy email error event example field file find first for format from function get group handler hash header html http image import index info input int item java json key label last length lib line list load local log main make map message method model module name new next node note null number object page param password path point print private process product project public query read record release report request response result return row sample schema script search secret section select send server service session set size source start state static status string style submit system table tag target task test text the time title token type unit update upload url user util value version view web with word work write your".split()
#: Words near a candidate that speak for a secret, for another use of random characters, or for an example.
SECRET_WORDS = r"(?i)(token|secret|passw|pwd|passphrase|credential|api_?-?key|access_?-?key|private|auth|bearer|login)"
OTHER_WORDS = r"(?i)(commit|sha\d*|md5|checksum|digest|uuid|guid|hash|revision|etag|isbn|card|phone|invoice|order|serial|version|build)"
EXAMPLE_WORDS = r"(?i)(example|sample|dummy|placeholder|changeme|your|test|fake|xxx)"

FEATURES = ("length", "digits", "upper", "lower", "other", "changes", "distinct", "rare_pairs", "dictionary", "slashes", "path", "hex", "only_digits", "uuid", "named", "quoted", "secret_words", "other_words", "example_words", "address", "pem", "prefixed")


def _share(value: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(value, kept, "")) / F.length(value)


def features(found: Column, before: Column, after: Column) -> Column:
    """Struct of FEATURES for a match and the text on both sides of it."""
    value = value_of(found)
    n = F.length(value).cast("double")
    classes = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), "_-+/=", "_____")
    runs = F.length(F.regexp_replace(classes, r"(.)\1*", "."))
    # A vowel and a consonant next to each other are what most letter pairs of words are.
    common = F.length(F.regexp_replace(F.lower(value), r"[bcdfghjklmnpqrstvwxyz]?[aeiouy][bcdfghjklmnpqrstvwxyz]?", ""))
    near = F.concat_ws(" ", before, F.regexp_replace(found, r"[^\s:=\"']{6,}$", ""), after)
    flag = lambda c: c.cast("double")
    return F.struct(
        n.alias("length"),
        _share(value, "[^0-9]").alias("digits"),
        _share(value, "[^A-Z]").alias("upper"),
        _share(value, "[^a-z]").alias("lower"),
        _share(value, "[A-Za-z0-9]").alias("other"),
        (F.greatest(runs - 1, F.lit(0)) / F.greatest(n - 1, F.lit(1.0))).alias("changes"),
        (F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(40.0))).alias("distinct"),
        (common / n).alias("rare_pairs"),
        (1 - F.length(F.regexp_replace(F.lower(value), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n).alias("dictionary"),
        F.length(F.regexp_replace(value, "[^/]", "")).cast("double").alias("slashes"),
        flag(before.rlike(r"[./\\]$") | after.rlike(r"^[./\\]\S")).alias("path"),
        flag(value.rlike("^[0-9a-fA-F]+$")).alias("hex"),
        flag(value.rlike("^[0-9+-]+$")).alias("only_digits"),
        flag(value.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")).alias("uuid"),
        flag(found.rlike(f"^{NAMED}$")).alias("named"),
        flag(before.rlike("[\"']$") | found.rlike("[:=]\\s{0,3}[\"']")).alias("quoted"),
        flag(near.rlike(SECRET_WORDS)).alias("secret_words"),
        flag(near.rlike(OTHER_WORDS)).alias("other_words"),
        flag(F.concat_ws(" ", near, value).rlike(EXAMPLE_WORDS)).alias("example_words"),
        flag(before.rlike(r"(@|://|www\.)\S*$") | after.rlike(r"^@|^\.[a-z]{2,}")).alias("address"),
        flag(found.startswith("-----BEGIN")).alias("pem"),
        flag(value.rlike(f"^{PREFIXED}")).alias("prefixed"),
    )


def value_of(found: Column) -> Column:
    """The part of a match that would be secret: what is set to a name, or all of it."""
    named = F.regexp_extract(found, f"^{NAMED}$", 1)
    return F.when(named != "", named).otherwise(found)


def labelled_findings(spark: SparkSession, n: int = MAX_FINDINGS, seed: int = SEED) -> DataFrame:
    """n findings with labels: before, found, after, label. Deterministic.

    True secrets are random strings of usual lengths and alphabets beside names
    of secrets; false ones are hashes, ids, paths, identifiers, numbers,
    versions and placeholders in the places where such stand. The words around
    both are drawn from DICTIONARY and letters alone, not from any table.
    """
    hexed = lambda k: F.sha2(F.concat_ws("|", F.lit(seed), F.lit(k), "id"), 256)
    draw = lambda k, of: F.element_at(F.array(*[F.lit(x) for x in of]), (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(len(of))) + 1).cast("int"))
    base64 = F.regexp_replace(F.base64(F.unhex(hexed("b"))), "[\\r\\n]", "")
    upper = F.upper(F.regexp_replace(F.base64(F.unhex(hexed("c"))), "[+/=]", "7"))
    word = lambda k: draw(k, DICTIONARY)
    number = lambda k, digits: F.substring(F.conv(F.substring(hexed(k), 1, 15), 16, 10), 1, digits)
    camel = F.concat(word(1), F.initcap(word(2)), number("d", 1), F.initcap(word(3)), F.initcap(word(4)))
    # A made-up word: letters of a hash, so that no language is known.
    made = F.translate(F.substr(hexed("w"), F.lit(1), draw(34, [3, 4, 5, 7, 9])), "0123456789", "oitresugan")
    prose = F.element_at(F.array(F.lit(""), F.concat(made, F.lit(" ")), F.concat(word(33), F.lit(" ")), F.concat(made, F.lit(" "), word(33), F.lit(" ")), F.concat(word(33), F.lit(": "))), draw(5, [1, 2, 2, 3, 4, 4, 5]))
    name = draw(6, ["token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth", "pwd"])
    setting = draw(7, [" = \"", "=", ": ", " = ", ":\"", "=\""])
    closing = F.when(setting.endswith("\""), "\"").otherwise("")
    some_hex = F.substr(hexed("a"), F.lit(1), draw(8, [16, 18, 20, 24, 32, 40, 48, 64]))
    mixed = F.substr(F.regexp_replace(base64, "=", ""), F.lit(1), draw(9, [16, 20, 24, 32, 40]))
    strong = F.concat(F.substring(base64, 2, 5), draw(10, ["!", "#", "$", "%", "&"]), F.substring(base64, 11, 5))
    pem = F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), base64, F.lit("\n-----END RSA PRIVATE KEY-----"))
    letters = lambda c: F.translate(c, "0123456789+/=", "qKzWxJvQbGkTp")
    empty = F.lit("")
    secret = [
        (prose, F.concat(name, setting, some_hex), closing),
        (prose, F.concat(name, setting, mixed), closing),
        (prose, F.concat(name, setting, strong), closing),
        (F.concat(prose, draw(11, ["", "key ", "aws ", "id = \"", "access "])), F.concat(draw(12, ["AKIA", "ASIA"]), F.substring(upper, 1, 16)), F.concat(empty, draw(13, ["", "\"", " ", ","]))),
        (F.concat(prose, draw(14, ["", "bearer ", "login "])), F.concat(draw(15, ["ghp_", "gho_", "sk-", "xoxb-", "glpat-"]), F.substring(F.regexp_replace(base64, "[+/=]", "x"), 1, 36)), empty),
        (F.concat(prose, draw(16, ["secret key ", "private token ", "credential "])), mixed, empty),
        (prose, pem, empty),
        (F.concat(prose, draw(17, ["", "key ", "aws "])), F.concat(draw(18, ["AKIA", "ASIA"]), F.substring(F.upper(letters(base64)), 1, 16)), empty),
        (F.concat(prose, draw(19, ["", "secret key ", "private token ", "credential "])), F.substr(letters(base64), F.lit(1), draw(20, [20, 24, 32, 40])), empty),
    ]
    other = [
        (F.concat(prose, draw(21, ["commit ", "sha256:", "checksum ", "md5 ", "etag \"", "revision "])), some_hex, empty),
        (F.concat(prose, draw(22, ["id ", "uuid=", "", "request "])), F.regexp_replace(F.substring(hexed("e"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), empty),
        (F.concat(prose, draw(23, ["/", "./", "https://", "in "])), F.concat_ws("/", word(1), word(2), F.concat(word(3), number("f", 2)), word(4)), draw(24, [".py", ".html", "", ".json"])),
        (prose, camel, draw(25, ["(", ".", " ", ","])),
        (F.concat(prose, draw(26, ["card ", "phone ", "", "invoice ", "order "])), number("g", 16), F.concat(empty, draw(27, ["", ".", ","]))),
        (prose, F.concat_ws("-", word(1), F.lit("2023"), number("h", 2), word(2)), empty),
        (prose, F.concat(name, setting, draw(28, ["your-token-here-1", "xxxxxxxxxxxx1234", "changeme123", "example-key-0001", "<token-goes-here-1>", "dummy_password_1", "os.environ[1]", "get_token(user1)"])), closing),
        (F.concat(prose, word(1), F.lit(".")), number("i", 2), F.concat(F.lit("@"), word(2), F.lit(".example.com"))),
        (F.concat(prose, made, F.lit("@")), F.concat(word(1), number("k", 1), F.lit("-"), word(2)), F.lit(".example.com")),
        (prose, F.concat(F.lit("-"), F.repeat(word(1), 3), number("l", 1)), empty),
        (prose, F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4)), F.initcap(word(29))), draw(30, ["(", ".", " ", ","])),
        (prose, F.concat_ws("-", F.initcap(word(1)), F.initcap(word(2)), word(3), F.initcap(word(4)), word(29)), empty),
        (F.concat(prose, draw(31, ["/", "./", "https://", "in "])), F.concat_ws("/", word(1), F.initcap(word(2)), F.concat(word(3), F.initcap(word(4))), word(29)), draw(32, [".py", ".html", "", ".json"])),
    ]
    kinds = [F.struct(b.alias("before"), f.alias("found"), a.alias("after"), F.lit(label).alias("label")) for label, of in ((1.0, secret), (0.0, other)) for b, f, a in of]
    at = (F.col("id") % len(kinds) + 1).cast("int")
    return spark.range(0, n, 1, 2).select(F.element_at(F.array(*kinds), at).alias("x")).select("x.*")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """Random forest over FEATURES of labelled findings (before, found, after, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.select(features(F.col("found"), F.col("before"), F.col("after")).alias("f"), "label").select("f.*", "label")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vectors)


def as_expression(forest, f: Column) -> Column:
    """The forest's probability of a secret as one SQL expression over a struct of FEATURES."""

    def tree(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(float(node.impurityStats().prob(1.0)))
        split = node.split()
        return F.when(f[FEATURES[split.featureIndex()]] <= split.threshold(), tree(node.leftChild())).otherwise(tree(node.rightChild()))

    roots = [tree(t._call_java("rootNode")) for t in forest.trees]
    return reduce(lambda a, b: a + b, roots) / len(roots)


def _scanned(docs: DataFrame, findings: DataFrame | None, threshold: float) -> DataFrame:
    """row (the columns of ``docs``), text, findings, and the text between candidates, null where there are none."""
    forest = train(findings if findings is not None else labelled_findings(docs.sparkSession))
    return_freed(docs.sparkSession)
    # Most texts have neither a digit, nor the name of a secret, nor a long run.
    may = F.col("text").rlike("[0-9]|(?i:token|secret|pass|pwd|key|auth)|[A-Za-z+/_-]{20}")
    split = docs.select(F.struct("*").alias("row"), "text", F.when(may, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).alias("found"))
    split = split.select("row", "text", F.when(F.size("found") > 0, F.col("found")).alias("found"))
    split = split.select("row", "text", "found", F.when(F.col("found").isNotNull(), F.split("text", CANDIDATE, -1)).alias("between"))
    at = lambda a, i: F.element_at(a, i + 1)
    context = F.transform(
        "found",
        lambda m, i: F.struct(
            m.alias("found"),
            F.right(at(F.col("between"), i), F.lit(CONTEXT)).alias("before"),
            F.left(at(F.col("between"), i + 1), F.lit(CONTEXT)).alias("after"),
            (F.length(at(F.col("between"), i)) + F.when(i > 0, F.length(F.element_at(F.col("found"), F.greatest(i, F.lit(1))))).otherwise(0)).alias("step"),
        ),
    )
    split = split.select("row", "text", "between", context.alias("context"))
    scored = split.select("row", "text", "between", F.transform("context", lambda c: F.struct(c["found"].alias("found"), c["step"].alias("step"), features(c["found"], c["before"], c["after"]).alias("f"))).alias("scored"))
    scored = scored.select("row", "text", "between", F.transform("scored", lambda c: F.struct(c["found"].alias("found"), c["step"].alias("step"), as_expression(forest, c["f"]).alias("p"))).alias("scored"))
    # Starts are running sums of steps, made in one pass.
    item = lambda c, start: F.struct(start.alias("start"), c["found"].alias("found"), value_of(c["found"]).alias("value"), c["p"].alias("probability"), (c["p"] >= threshold).alias("is_secret"))
    empty = F.array().cast("array<struct<start:bigint,found:string,value:string,probability:double,is_secret:boolean>>")
    begun = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("items"))
    added = lambda s, c: F.struct((s["at"] + c["step"]).alias("at"), F.concat(s["items"], F.array(item(c, s["at"] + c["step"]))).alias("items"))
    blocks = F.aggregate("scored", begun, added, lambda s: s["items"])
    return scored.select("row", "text", "between", F.coalesce(blocks, empty).alias("findings"))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``findings`` to ``docs``: an array of (start, found, value, probability, is_secret) for each candidate of ``text``.

    The forest is trained from ``findings`` (labelled_findings by default),
    then scores each candidate within its row: one pass, no shuffle. ``start``
    counts code points to the match. A null or empty text has no findings; a
    text of any length is read whole, and a value has no longest length.
    Repeated rows are scanned alike, candidates of equal probability keep the
    order of the text, and an empty table gives none. An existing column
    findings is replaced, all others are kept whatever their names.
    """
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != "findings"]
    return _scanned(docs, findings, threshold).select(*kept, "findings")


def redact(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by ``mark``; its columns and rows stay as they are.

    Secrets are cut out where they were found, so the same letters within
    other words stay; a candidate that is equal to a secret of the same text
    goes with it. Null texts stay null, texts without secrets as they are, of
    whatever length; repeated rows stay repeated, and an empty table is empty.
    """
    scanned = _scanned(docs, findings, threshold)
    hidden = F.transform(F.filter("findings", lambda f: f["is_secret"]), lambda f: f["value"])
    scanned = scanned.select("row", "text", "between", "findings", F.when(F.exists("findings", lambda f: f["is_secret"]), hidden).alias("hidden"))
    put = lambda f: F.when(F.array_contains(F.col("hidden"), f["value"]), F.concat(F.left(f["found"], F.length(f["found"]) - F.length(f["value"])), F.lit(mark))).otherwise(f["found"])
    ends = F.concat(F.transform("findings", put), F.array(F.lit("")))
    text = F.when(F.col("hidden").isNotNull(), F.array_join(F.zip_with("between", ends, lambda a, b: F.concat(a, b)), "")).otherwise(F.col("text"))
    return scanned.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
