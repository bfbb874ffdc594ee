"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

Everything on the main path is a DataFrame or SQL function. The forest is
fitted with ``pyspark.ml`` on labelled findings and then written out as one SQL
expression, so scanning is a narrow projection over the documents. What the
features look up is learned too: the dictionary is the words that the corpus
uses most, and the words beside a candidate that speak for or against a secret
are those of the labelled findings.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from random import Random

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import keeps_names, saved

#: A name of something secret and an assignment.
NAMED = (
    r"(?<![A-Za-z0-9])[A-Za-z0-9_.-]{0,32}?(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)"
    r"[A-Za-z0-9_]{0,16}+[\"']?+\s{0,3}+(?:[:=]>?+|(?i:is|was)\s)\s{0,3}+"
)
#: What may be secret: eight characters or more that are assigned to such a
#: name (up to the closing quote if there is one), a signed token of dotted
#: parts, or any run of sixteen key characters. No group repeats, so Java's
#: matcher does not recurse, however long a run is.
VALUE = r"(?:\"[^\"\r\n]{8,}+(?=\")|'[^'\r\n]{8,}+(?=')|[^\s\"'<>;,]{8,}+)"
SIGNED = r"(?<![A-Za-z0-9_+/-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{8,}+)?+"
RUN = r"(?<![A-Za-z0-9_+/-])(?=[_+/-]*+[A-Za-z0-9])[A-Za-z0-9_+/-]{16,}+(?:={1,2}+(?![A-Za-z0-9\"'=]))?+"
CANDIDATE = f"{NAMED}{VALUE}|{SIGNED}|{RUN}"
MASK = "[REDACTED]"
THRESHOLD = 0.5
CONTEXT = 48
#: Words of context before and after a candidate that are looked up.
BEFORE, AFTER = 4, 2
TREES, DEPTH, SEED = 40, 8, 7
#: Labelled findings, words of the dictionary, and words of context on either side, at most.
FINDINGS, DICTIONARY, NEIGHBOURS = 8000, 2000, 300
#: Lengths are summed in runs of this many candidates.
BLOCK = 256

#: Features of a candidate c between the texts b and a, as SQL; p are its letter runs, w the words beside it.
FEATURES = {
    "chars": "CAST(length(c) AS DOUBLE)",
    "transitions": r"(length(regexp_replace(k, '(.)\\1+', '$1')) - 1) / CAST(length(c) AS DOUBLE)",
    "digit_share": "length(regexp_replace(c, '[^0-9]', '')) / CAST(length(c) AS DOUBLE)",
    "upper_share": "length(regexp_replace(c, '[^A-Z]', '')) / CAST(length(c) AS DOUBLE)",
    "other_share": "length(regexp_replace(c, '[A-Za-z0-9]', '')) / CAST(length(c) AS DOUBLE)",
    "distinct_share": "size(array_distinct(split(c, ''))) / CAST(length(c) AS DOUBLE)",
    "hex_only": "CAST(c RLIKE '^(?:[0-9a-f]++|[0-9A-F]++)$' AS DOUBLE)",
    "longest_part": "array_max(transform(split(c, '[_/+.-]'), x -> length(x))) / CAST(length(c) AS DOUBLE)",
    "parts": "CAST(size(split(c, '[_/+.-]')) AS DOUBLE)",
    "letter_run": "coalesce(array_max(transform(p, x -> length(x))), 0) / CAST(length(c) AS DOUBLE)",
    "dictionary": "aggregate(filter(p, x -> {dictionary}), 0, (n, x) -> n + length(x)) / CAST(length(c) AS DOUBLE)",
    "vowels": "length(regexp_replace(lower(c), '[^aeiou]', '')) / CAST(length(c) AS DOUBLE)",
    "blanks": r"CAST(c RLIKE '\\s' AS DOUBLE)",
    "marked": r"CAST(c RLIKE '[(){$<>%]' AS DOUBLE)",
    "path": r"CAST(b RLIKE '[/\\\\.~@]$' OR a RLIKE '^[.(][A-Za-z)]' OR size(split(c, '/')) > 2 OR b RLIKE '://\\S*$' AS DOUBLE)",
    "assigned": r"""CAST(b RLIKE '[:=]>?\\s*["'']?$' AS DOUBLE)""",
    "quoted": r"""CAST(b RLIKE '["''`]$' AND a RLIKE '^["''`]' AS DOUBLE)""",
    "speaking_for": "CAST(size(filter(w, x -> {speak_for})) AS DOUBLE)",
    "speaking_against": "CAST(size(filter(w, x -> {speak_against})) AS DOUBLE)",
}
CLASSES = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '[a-z]', 'a'), '[A-Z]', 'A'), '[0-9]', '0'), '[^aA0]', '-')"
#: Letter runs in lower case, camel case cut.
RUNS_OF = r"regexp_extract_all(lower(regexp_replace(c, '([a-z])([A-Z])', '$1 $2')), '[a-z]{3,}', 0)"
WORDS_OF = (
    f"concat(slice(reverse(regexp_extract_all(lower(b), '[a-z]{{2,}}', 0)), 1, {BEFORE}), slice(regexp_extract_all(lower(a), '[a-z]{{2,}}', 0), 1, {AFTER}))"
)


def sql_string(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


@dataclass(frozen=True)
class Lookups:
    """Learned words: of the corpus, and beside secrets and other findings."""

    dictionary: tuple[str, ...] = ()
    speak_for: tuple[str, ...] = ()
    speak_against: tuple[str, ...] = ()

    def among(self, name: str) -> str:
        words = getattr(self, name)
        return f"x IN ({', '.join(repr(w) for w in words)})" if words else "false"

    def fill(self, sql: str) -> str:
        for name in ("dictionary", "speak_for", "speak_against"):
            sql = sql.replace(f"{{{name}}}", self.among(name))
        return sql


@dataclass(frozen=True)
class SecretModel:
    lookups: Lookups
    #: Share of the forest's votes, as SQL over a struct f of the features.
    votes: str


def with_candidates(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add __found (candidates), __lead (characters of a match before its candidate), __gaps (texts between the matches) and __around (c, b, a).

    The pattern is first tested alone, so most texts are passed over once.
    """
    pattern = sql_string(CANDIDATE)
    lead = sql_string(f"^{NAMED}[\"']?")
    df = df.withColumn("__has", F.expr(f"coalesce(`{text_col}` RLIKE '{pattern}', false)"))
    df = df.withColumns(
        {
            "__match": F.expr(f"CASE WHEN __has THEN regexp_extract_all(`{text_col}`, '{pattern}', 0) ELSE CAST(array() AS ARRAY<STRING>) END"),
            "__gaps": F.expr(f"CASE WHEN __has THEN split(`{text_col}`, '{pattern}', -1) ELSE CAST(array() AS ARRAY<STRING>) END"),
        }
    ).drop("__has")
    value = f"element_at(transform(array(regexp_replace(m, '{lead}', '')), v -> IF(length(v) >= 8, v, m)), 1)"
    df = df.withColumn("__found", F.expr(f"transform(__match, m -> {value})"))
    df = df.withColumn("__lead", F.expr("transform(__match, (m, i) -> length(m) - length(__found[i]))"))
    before = f"right(concat(IF(i > 0, right(__match[i - 1], {CONTEXT}), ''), right(__gaps[i], {CONTEXT}), left(m, __lead[i])), {CONTEXT})"
    after = f"left(__gaps[i + 1], {CONTEXT})"
    return df.withColumn("__around", F.expr(f"transform(__match, (m, i) -> struct(__found[i] AS c, {before} AS b, {after} AS a))"))


def features_sql(lookups: Lookups) -> str:
    """The struct of features over a struct x of c, b and a; each name is bound once by a one-element transform."""
    fields = ", ".join(f"'{name}', coalesce(CAST({lookups.fill(sql)} AS DOUBLE), 0D)" for name, sql in FEATURES.items())
    bound = f"named_struct({fields})".replace("(k,", f"({CLASSES},")
    for name, sql in (("p", RUNS_OF), ("w", WORDS_OF), ("a", "y.a"), ("b", "y.b"), ("c", "y.c")):
        bound = f"element_at(transform(array({sql}), {name} -> {bound}), 1)"
    return bound


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The ``size`` letter runs of three or more that the texts use most, counted over all documents."""
    words = docs.select(F.explode(F.split(F.lower(docs["text"]), "[^a-z]+")).alias("word")).where(F.length("word").between(3, 24))
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [r["word"] for r in top.collect()]


#: Names, joints and quotes of the findings made by rule; some of the others use them too.
NAMES = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apiKey", "secret_key", "access_key", "private_key", "credential", "auth_token", "client_secret", "db_password", "session_token", "access_key_id", "aws_secret_access_key")
JOINTS = (" = ", "=", ": ", ":", " => ", " is ", " := ", "= ")
LEADS = ("and the ", "export ", "set ", "# ", "use ", "with ", "config ", "login ", "  ", "-- ", "my ", "", "header ", "export MY_", "their ", "the old ")
HEADERS = ("Authorization: Bearer ", "authorization: token ", "-H 'x-api-key: ", "bearer ")
TAILS = (" of the", "\n", " && make", ",", " in it", "; end", "", ")")
PREFIXES = ("ghp_", "sk_live_", "xoxb-", "AIza", "glpat-", "npm_", "pk-")
OTHER_LEADS = (
    "fixed in commit ", "commit ", "sha256: ", "sha1 ", "md5 = ", "checksum ", "etag: ", "digest: ", "revision ", "build ", "uuid ", "request id ", "trace id: ", "order number ", "paid with card ",
    "invoice ", "isbn ", "doi ", "see page ", "version ", "call ", "the word ", "function ", "class ", "image data ", "file ", "open ", "visit ", "on ", "entitled ",
)
WEAK = ("your_{}_here", "example-{}-value", "<{}>xxxxxxxx", "$({}_PLACEHOLDER)", "os.environ['{}']", "changeme_{}", "xxxxxxxxxxxxxxxx", "getenv({}_NAME)")
FALLBACK = ("some", "words", "that", "every", "text", "would", "have", "inside")
HEX, MIXED = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def finding(rng: Random, words: list[str], is_secret: bool) -> str:
    """One finding made by rule between words of prose: names, joints, quotes, lengths and words are chosen apart.

    A secret is a key (hex, letters and digits, capitals, with a provider's
    prefix, signed, or a passphrase) under a name, after a header or by itself.
    The others are digests, ids, numbers, dates, paths, addresses, titles,
    identifiers, encoded data, long words and placeholders, the last under the
    same names.
    """
    pick = rng.choice
    some = lambda letters, n: "".join(rng.choices(letters, k=n))
    word = lambda: pick(words)
    prose = lambda n: "".join(f"{word()} " for _ in range(rng.randint(0, n)))
    between = lambda made: f"{prose(4)}{made} {pick(('', '', f'https://{word()}.com '))}{prose(3)}"
    name = pick(NAMES)
    name = pick([name, name, name.upper(), name.replace("_", "-").title()])
    under = lambda value, quote: f"{pick(LEADS)}{name}{pick(JOINTS)}{quote}{value}{quote}{pick(TAILS)}"
    quote, length = pick(('"', "'", "", '"')), pick((16, 20, 24, 28, 32, 40, 48, 64))
    if is_secret:
        known = [f"AKIA{some('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 16)}", pick(PREFIXES) + some(MIXED, rng.randint(20, 36)), f"eyJ{some(MIXED, 33)}.eyJ{some(MIXED, rng.randint(30, 60))}.{some(MIXED + '_-', 43)}"]
        key = pick([some(HEX, length), some(HEX.upper(), length), some(MIXED + "+/", length), some(MIXED, length), some(MIXED[:52], length), *known])
        phrase = pick([f"{word().title()}{rng.randint(10, 99)}{pick('!#$?@&')}{word()}", f"{word()}-{word()}-{word()}-{rng.randint(1, 99)}", f"{word()}-{word()}-{rng.randint(1, 99)}", some(MIXED, 5) + pick("!%&.") + some(MIXED, rng.randint(3, 9)), some(MIXED, rng.randint(8, 15))])
        made = pick([under(key, quote), under(key, quote), under(key, quote), under(phrase, quote), f"{pick(HEADERS)}{key}{pick(TAILS)}", f"{pick(LEADS)}{quote}{pick(known)}{quote}{pick(TAILS)}"])
        return between(made)
    slug = pick("-_/").join(word() for _ in range(rng.randint(3, 6)))
    ids = [some(HEX, pick((32, 40, 64))), "-".join(some(HEX, n) for n in (8, 4, 4, 4, 12)), some("0123456789", rng.randint(16, 20))]
    camel = word() + "".join(word().title() for _ in range(4))
    kinds = [
        *ids, f"20{some('0123456789', 2)}-10-11T10-11-{some('0123456789', 2)}", f"https://{word()}.com/{slug}.html", f"/usr/lib/{slug}/{word()}{some('0123456789', 3)}.bin", slug, f"{slug}-{some('0123456789', 4)}",
        pick((camel, camel + "()", camel[0].upper() + camel[1:])), "".join(word() for _ in range(6)), f"data:image/png;base64,{some(MIXED + '+/', 80)}==", "_".join(word().upper() for _ in range(5)), pick("-=_#") * rng.randint(16, 60) + " " + slug,
    ]
    long_word = "".join(word() for _ in range(rng.randint(3, 6)))
    options = [
        f"{pick(OTHER_LEADS)}{pick(kinds)}{pick(TAILS)}", f"{word()} {ids[2]} {word()}", f"{pick(OTHER_LEADS)}{pick(ids)}{pick(TAILS)}", f"{word()} {pick(kinds[2:])}{pick(TAILS)}", f"{word()} {pick((long_word, long_word.title()))} {word()}", f"{word()} {long_word} {word()}".upper(),
        under(pick(WEAK).format(name), quote), f"{pick(LEADS)}{name} was {word()}-{word()} {word()}{pick(TAILS)}",
    ]
    return between(pick(options))


def labelled_findings(spark: SparkSession, words: list[str], n: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """(text, label): ``n`` findings made by rule, every other one a secret, sent as one literal."""
    rng = Random(seed)
    rows = [{"text": finding(rng, words or list(FALLBACK), k % 2 == 0), "label": float(k % 2 == 0)} for k in range(n)]
    made = F.from_json(F.lit(json.dumps(rows)), "array<struct<text: string, label: double>>")
    return spark.range(1).select(F.explode(made).alias("r")).select("r.text", "r.label")


def neighbours(rows: DataFrame, label: str = "label") -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(words beside secrets, words beside other findings): at least three times as frequent there as beside the others, a dozen times or more in all."""
    seen = rows.select(label, F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.sum(label).alias("yes"), F.count("*").alias("n"))
    seen = seen.where("n >= 12").withColumn("no", F.col("n") - F.col("yes")).orderBy(F.desc("n"), "word").limit(4 * NEIGHBOURS).collect()
    yes = [r["word"] for r in seen if r["yes"] + 1 > 3 * (r["no"] + 1)]
    no = [r["word"] for r in seen if r["no"] + 1 > 3 * (r["yes"] + 1)]
    return tuple(yes[:NEIGHBOURS]), tuple(no[:NEIGHBOURS])


def tree_sql(lines: list[str]) -> str:
    """One tree of a model's printed form as a SQL expression (the class it votes for)."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return line.split(":")[1].strip() + "D"
    feature, cut = re.fullmatch(r"If \(feature (\d+) <= ([-\d.Ee]+)\)", line).groups()
    yes = tree_sql(lines)
    if not re.match(r"Else \(feature", lines.pop(0).strip()):
        raise ValueError("unexpected form of a tree")
    no = tree_sql(lines)
    return f"IF(f.{list(FEATURES)[int(feature)]} <= {float(cut)!r}D, {yes}, {no})"


def train(docs: DataFrame, findings: DataFrame | None = None) -> SecretModel:
    """Learn dictionary and neighbouring words and fit the forest on labelled findings (text, label; default: made by rule)."""
    spark = docs.sparkSession
    words = dictionary(docs)
    findings = labelled_findings(spark, words) if findings is None else findings.select("text", "label")
    rows = with_candidates(findings).select("label", F.explode("__around").alias("y"))
    beside = neighbours(rows.select("label", F.expr(WORDS_OF.replace("lower(b)", "lower(y.b)").replace("lower(a)", "lower(y.a)")).alias("w")))
    lookups = Lookups(tuple(words), *beside)
    data = saved(rows.select("label", F.expr(features_sql(lookups)).alias("f")), "labelled-findings").select("label", "f.*").coalesce(1)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data).select("label", "features")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(data)
    trees = re.split(r"\n\s*Tree \d+ \(weight [\d.]+\):\n", model.toDebugString)[1:]
    votes = [tree_sql([x for x in t.split("\n") if x.strip()]) for t in trees]
    return SecretModel(lookups, f"({' + '.join(votes)}) / {len(votes)}D")


def with_findings(docs: DataFrame, model: SecretModel | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with __match, __found, __lead, __gaps and __scores."""
    model = model or train(docs)
    found = with_candidates(docs, text_col).withColumn("__features", F.expr(f"transform(__around, y -> {features_sql(model.lookups)})"))
    return found.withColumn("__scores", F.expr(f"transform(__features, f -> {model.votes})")).drop("__features", "__around")


def scan_secrets(docs: DataFrame, model: SecretModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Findings of whole texts: doc_id, start (characters, from 0), chars, candidate, score, is_secret.

    One row per candidate, false positives included (is_secret false). A
    candidate is eight characters or more behind the name of something secret
    and an assignment, a signed token, or a run of sixteen key characters or
    more; anything else is not looked at. Null and
    empty texts have none; repeated rows have theirs each; null ids are kept;
    other columns are ignored; an empty table gives no rows. Starts are running
    sums over runs of ``BLOCK`` candidates and over the runs, so a text of very
    many candidates costs little more for each.
    """
    found = with_findings(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), model)
    found = found.withColumn("__span", F.expr("transform(__match, (m, i) -> CAST(length(__gaps[i]) + length(m) AS BIGINT))"))
    blocks = f"transform(sequence(0, size(__span) div {BLOCK}), k -> aggregate(slice(__span, k * {BLOCK} + 1, {BLOCK}), 0L, (n, g) -> n + g))"
    found = found.withColumn("__blocks", F.expr(blocks))
    starts = (
        f"transform(__match, (m, i) -> aggregate(slice(__blocks, 1, i div {BLOCK}), 0L, (n, g) -> n + g)"
        f" + aggregate(slice(__span, (i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK}), 0L, (n, g) -> n + g) + length(__gaps[i]) + __lead[i])"
    )
    zipped = F.arrays_zip(F.expr(starts).alias("start"), F.col("__found").alias("candidate"), F.col("__scores").alias("score"))
    rows = found.select("doc_id", F.explode(zipped).alias("x"))
    return rows.select(
        "doc_id", "x.start", F.length("x.candidate").cast("long").alias("chars"), "x.candidate", "x.score", (F.col("x.score") >= threshold).alias("is_secret")
    )


@keeps_names
def redacted(docs: DataFrame, model: SecretModel | None = None, threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """The documents with every found secret replaced by ``mask`` (n_chars follows); others are unchanged, all columns kept."""
    found = with_findings(docs, model)
    hit = F.exists("__scores", lambda s: s >= threshold)
    rebuilt = F.expr(
        "concat(__gaps[0], array_join(transform(__match, (m, i) ->"
        f" concat(IF(__scores[i] >= {threshold}, concat(left(m, __lead[i]), '{sql_string(mask)}'), m), __gaps[i + 1])), ''))"
    )
    out = found.withColumn("__text", F.when(hit, rebuilt).otherwise(F.col("text")))
    changed = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(hit, F.length("__text").cast(kind)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(docs.columns)
