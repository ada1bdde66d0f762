"""Secret scanning with a random forest that removes false positives.

Wide patterns name candidates; a forest trained on labelled findings tells secrets from digests, ids, numbers and
placeholders, by the candidate's length and character transitions, how much of it dictionary words cover, the
path it stands in and the words around it.  Everything is SQL functions and Spark's own learner.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.base import quoted

#: What is assigned to a telling name, quoted or not, or a run of key-like characters with a known prefix, a digit,
#: a capital after another character than a capital, or five consonants.
CANDIDATE = (
    r"(?<=[=:\"'\s])(?i:(?<=(?:password|passwd|passphrase|pwd|secret|token|credential|credentials|auth|apikey|accesskey|secretkey|privatekey|[_-]key)"
    r"[\"']{0,1}[ \t]{0,8}[=:][ \t]{0,8}[\"']{0,1}))[^\s\"'<>,;]{6,}"
    r"|(?<![A-Za-z0-9+/_-])(?=AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[bap]-|AIza|eyJ|[A-Za-z+/_-]*+[0-9]"
    r"|[A-Za-z+/_-]*?(?:[a-z+/_-][A-Z]|[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{5}))[A-Za-z0-9+/_-]{12,}={0,2}"
)
#: Characters of which one that a text does not hold marks its candidates.
MARKS = [chr(c) for c in [*range(1, 9), *range(0xF000, 0xF018)]]
#: Code points looked at on each side of a candidate.
AROUND = 60
#: Findings that a fit may use.
MAX_TRAIN = 6_000
TREES, DEPTH = 40, 8
# Words that candidates which are no secrets are made of, and words around both kinds.
DICTIONARY = (
    "example sample test demo dummy fake placeholder changeme your here key token secret password value user name admin "
    "default config file path data image static assets html index page post article content version release build main "
    "app web api http https www com org net img css js min the and for with from this that item order ref number id code"
).split()
SECRET_WORDS = "password|passwd|passphrase|pwd|secret|token|api[ _-]?key|access[ _-]?key|[a-z][_-]key|auth|bearer|credential|private"
HARMLESS_WORDS = "sha1|sha256|sha|md5|checksum|digest|commit|revision|etag|uuid|guid|isbn|phone|order|invoice|card|example|sample|hash"
HARMLESS_PATHS = "test|tests|example|examples|sample|doc|docs|fixture|mock"
FEATURES = [
    "f_length", "f_digits", "f_upper", "f_lower", "f_marks", "f_changes", "f_distinct", "f_repeats", "f_vowels", "f_covered",
    "f_hex", "f_number", "f_uuid", "f_prefix", "f_longest_word", "f_path", "f_assigned", "f_quoted", "f_secret_near", "f_harmless_near", "f_path_around",
]


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, path, start (code point, from 0), candidate, before, after.

    A null text has none, repeated rows have theirs each.  In a text that holds every one of ``MARKS`` the first of them is
    read as U+FFFD.
    """
    body = F.coalesce(quoted(text), F.lit(""))
    rows = docs.select(
        quoted(key).alias("doc_id"), (F.coalesce(quoted(path).cast("string"), F.lit("")) if path else F.lit("")).alias("path"), body.alias("body"),
    )
    # one pass sets every candidate between two marks that the text does not hold, so the pieces alternate
    free = F.coalesce(*[F.when(~F.contains("body", F.lit(m)), F.lit(m)) for m in MARKS])
    rows = rows.withColumn("mark", free).select(
        "doc_id", "path", F.coalesce("mark", F.lit(MARKS[0])).alias("mark"),
        F.when(F.col("mark").isNull(), F.translate("body", MARKS[0], "\ufffd")).otherwise(F.col("body")).alias("body"),
    )
    between = F.concat("mark", F.lit("$0"), "mark")
    pieces = rows.select("doc_id", "path", F.split(F.regexp_replace("body", F.lit(CANDIDATE), between), F.col("mark"), -1).alias("pieces"))
    found = pieces.select(
        "doc_id", "path",
        F.filter("pieces", lambda x, i: i % 2 == 1).alias("found"),
        F.filter("pieces", lambda x, i: i % 2 == 0).alias("rest"),
    )
    # what stands between two candidates is the text after one and before the next
    each = found.select(
        "doc_id", "path",
        F.aggregate(
            F.arrays_zip("rest", "found"),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda s, x: F.struct(
                (s["at"] + F.length(x["rest"]) + F.coalesce(F.length(x["found"]), F.lit(0))).alias("at"),
                F.concat(s["starts"], F.array(s["at"] + F.length(x["rest"]))).alias("starts"),
            ),
        )["starts"].alias("starts"),
        "found",
        F.transform("rest", lambda r: F.right(r, F.lit(AROUND))).alias("lead"),
        F.transform("rest", lambda r: F.left(r, F.lit(AROUND))).alias("tail"),
    )
    zipped = F.arrays_zip("starts", "found", "lead", F.slice("tail", F.lit(2), F.size("tail")).alias("next"))
    return each.select("doc_id", "path", F.explode(zipped).alias("c")).select(
        "doc_id", "path", F.col("c.starts").alias("start"), F.col("c.found").alias("candidate"),
        F.col("c.lead").alias("before"), F.coalesce("c.next", F.lit("")).alias("after"),
    ).filter("candidate is not null")


def with_features(found: DataFrame) -> DataFrame:
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.greatest(F.length(c), F.lit(1))
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    words = F.regexp_extract_all(low, F.lit("[a-z]{3,}"), F.lit(0))
    left = F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")
    near = F.lower(F.concat(F.right("before", F.lit(30)), F.lit(" "), F.left("after", F.lit(20))))
    values = {
        "f_length": F.length(c),
        "f_digits": share("[0-9]"), "f_upper": share("[A-Z]"), "f_lower": share("[a-z]"), "f_marks": share("[^A-Za-z0-9]"),
        "f_changes": F.regexp_count(c, F.lit("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])")) / n,
        "f_distinct": F.size(F.array_distinct(F.split(low, ""))) / n,
        "f_repeats": F.regexp_count(c, F.lit(r"(.)(?=\1)")) / n,
        "f_vowels": share("[aeiouAEIOU]"),
        "f_covered": (n - F.length(left)) / n,
        "f_hex": low.rlike("^[0-9a-f]+$"), "f_number": c.rlike("^[0-9+/_-]+$"),
        "f_uuid": low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        "f_prefix": c.rlike("^(AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[bap]-|AIza|eyJ)"),
        "f_longest_word": F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)),
        "f_path": F.col("path").rlike(f"(?i)(^|[^a-z])({HARMLESS_PATHS})([^a-z]|$)"),
        "f_assigned": F.col("before").rlike("[=:]\\s{0,8}[\"']?$"), "f_quoted": F.col("before").rlike("[\"'`]$"),
        "f_secret_near": near.rlike(SECRET_WORDS), "f_harmless_near": near.rlike(f"(^|[^a-z])({HARMLESS_WORDS})([^a-z]|$)"),
        "f_path_around": F.concat(F.right("before", F.lit(3)), F.left("after", F.lit(2))).rlike("[/.@]"),
    }
    return found.withColumns({k: v.cast("double") for k, v in values.items()})


def labelled_findings(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MAX_TRAIN) -> DataFrame:
    """Findings whose label is known, for want of a labelled table: candidate, before, after, path, label.

    Seeded secrets and look-alikes in the shapes that each is known by, set into the words of at most
    ``most`` documents, chosen by the hash of their text.
    """
    body = F.coalesce(quoted(text), F.lit(""))
    chosen = docs.select(F.substring(body, 1, 400).alias("body"), F.xxhash64(body).alias("h")).orderBy("h", "body").limit(most)
    words = F.split("body", r"\s+")
    seed = F.sha2(F.col("h").cast("string"), 512)
    take = lambda start, n: F.substring(seed, start, n)
    base = F.regexp_replace(F.base64(F.unhex(take(1, 96))), "[=]", "")
    alnum = F.regexp_replace(base, "[+/]", "x")
    letters = F.translate(alnum, "0123456789", "GhJkLmNpQr")
    number = F.regexp_replace(seed, "[a-f]", "")
    word = lambda i: F.coalesce(F.element_at(words, F.least(F.lit(i), F.size(words))), F.lit(""))
    name = F.regexp_replace(F.lower(F.concat_ws("-", word(3), word(4), word(5))), "[^a-z-]", "")
    titled = [F.initcap(F.regexp_replace(word(i), "[^A-Za-z]", "")) for i in (3, 4, 5)]
    uuid = F.concat_ws("-", take(1, 8), take(9, 4), take(13, 4), take(17, 4), take(21, 12))
    secrets = [
        ('token = "', take(1, 40), '"'), ("password=", take(41, 18), " "), ("", F.concat(F.lit("AKIA"), F.upper(F.substring(alnum, 1, 16))), " "),
        ('api_key: "', F.substring(base, 1, 40), '"'), ("Authorization: Bearer ", F.substring(alnum, 1, 36), " "), ("", F.concat(F.lit("ghp_"), F.substring(alnum, 3, 36)), " "),
        ("secret = '", F.substring(base, 5, 24), "'"), ("pwd:", F.concat(F.substring(alnum, 2, 9), F.lit("!7")), " "), ("key=", F.concat(F.lit("sk_live_"), F.substring(alnum, 4, 24)), " "),
        ("auth_token=", take(33, 32), "&"), ('"password": "', F.substring(letters, 3, 11), '"'), ("", F.concat(F.lit("AKIA"), F.upper(F.substring(letters, 5, 16))), " "),
        ("secret_key: ", F.substring(letters, 1, 24), " "), ("", F.substring(letters, 7, 20), " "),
    ]
    harmless = [
        ("commit ", take(1, 40), " "), ("md5: ", take(5, 32), " "), ("sha256 ", take(1, 64), " "), ("", F.substring(number, 1, 16), " "),
        ("id: ", uuid, " "), ("https://", F.concat(name, F.lit("/2024/"), name), " "), ("token = \"", F.lit("YOUR_TOKEN_HERE_123"), '"'),
        ("password=", F.lit("changeme123example"), " "), ("src/", F.concat(name, F.lit("/index2/page_10")), ".html"), ("order ", F.concat(F.lit("ORD-"), F.substring(number, 1, 12)), " "),
        ("secret: ", F.lit("xxxxxxxxxxxxxxxx1"), " "), ("", F.concat(name, F.lit("-"), F.substring(number, 1, 3)), " "), ("phone +", F.substring(number, 2, 13), " "),
        ("", F.concat(*titled), "("), ("", F.concat_ws("-", *titled), " "), ("", F.concat_ws("/", *titled), " "), ('"password": "', F.lit("example-password"), '"'),
    ]

    def example(place: int, kinds: list, label: int) -> Column:
        before, value, after = kinds[place]
        return F.struct(
            F.concat(F.concat_ws(" ", F.slice(words, 1, 6)), F.lit(" " + before)).alias("before"), value.alias("candidate"),
            F.concat(F.lit(after), F.concat_ws(" ", F.slice(words, 7, 5))).alias("after"), F.lit(label).alias("label"),
        )

    every = F.array(*[example(i, secrets, 1) for i in range(len(secrets))], *[example(i, harmless, 0) for i in range(len(harmless))])
    # each document gives about a quarter of them
    rows = chosen.select("h", F.posexplode(every).alias("place", "e")).filter(F.pmod(F.xxhash64("h", "place"), F.lit(4)) == 0)
    return rows.select(
        "e.candidate", "e.before", "e.after", F.when(F.pmod("h", F.lit(7)) == 0, "docs/example").otherwise("src").alias("path"), "e.label",
    ).filter(F.length("candidate") >= 6)


def fit(findings: DataFrame, seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest on labelled findings (candidate, before, after, path, label); None without any."""
    if findings.isEmpty():
        return None
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings)).select("features", F.col("label").cast("double"))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt", maxBins=32).fit(rows)


def scan(
    docs: DataFrame, model: RandomForestClassificationModel | None, key: str = "doc_id", text: str = "text", path: str | None = "source",
    least: float = 0.5,
) -> DataFrame:
    """One row per candidate: doc_id, start, length, digest (sha256 of it), probability, is_secret.

    Whole texts are searched.  A null or empty text has no candidates; a null path is an empty one; repeated rows
    are each reported; an empty table gives no rows; other columns are not looked at.  Without a model nothing is taken for a secret.
    """
    found = with_features(candidates(docs, key, text, path))
    scored = found.withColumn("probability", F.lit(0.0))
    if model is not None:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)).withColumn(
            "probability", vector_to_array("probability")[1]
        )
    return scored.select(
        "doc_id", "start", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("digest"),
        "probability", (F.col("probability") >= least).alias("is_secret"),
    )
