"""Secret scan with a random forest that removes false positives (operator 7).

All of it is DataFrame work in the JVM.  One pattern finds candidates with their place and what stands around
them; column expressions turn each into features (length, character classes and transitions, dictionary
coverage, path, neighbouring words); a random forest trained on labelled findings keeps or drops it.

Labelled findings are a table (value, before, after, label).  Where none is given, a bounded seeded one
is made by rule from the usual shapes of credentials and of what is taken for them.

Candidates are web tokens of two or three parts, private keys' headers, what is assigned to a name that speaks of a credential
(eight characters or more of any kind, digits or none), a URL's password, and runs of key characters with a digit.

Defined results: null and empty texts have no findings; a null doc_id passes through; rows that share a
doc_id each give their findings; very long texts are read whole; candidates don't overlap: the leftmost is taken, of those
that begin at one place the first in the order above, and the next begins where it ends or later; an empty table gives no
rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import json
import random
import uuid
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CHARS = r"A-Za-z0-9+/_\-"
_PRINTED = r"!#-&(-+\-.-:=?-~"  # but quotes, angles, commas and semicolons
_NAMED = r"(?i:passw|passphrase|pwd|secret|token|api|key|credential|auth|bearer)"
#: In the order in which they are tried at a place.
CANDIDATE = "(?:" + "|".join([
    rf"(?<![{_CHARS}])eyJ[A-Za-z0-9_\-]{{6,}}(?:\.[A-Za-z0-9_\-]{{4,}}){{1,2}}",
    r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----",
    rf"(?<=[=:][\"' ]{{0,2}})(?<={_NAMED}[A-Za-z0-9_\-]{{0,16}}[\"']{{0,1}} {{0,1}}[=:] {{0,1}}[\"']{{0,1}})[{_PRINTED}]{{7,199}}[A-Za-z0-9!#$%&*+/=?@^_~\-]",
    r"(?<=:)(?<=://[A-Za-z0-9._\-]{1,32}:)[^\s/@:]{6,64}(?=@)",
    rf"(?<![{_CHARS}])(?=[A-Za-z+/_\-]*+[0-9])[{_CHARS}]{{12,}}+={{0,2}}",
]) + ")"
#: Characters before and after that count as neighbourhood.
BEFORE, AFTER = 48, 24

# Words that name credentials, words that name other long identifiers, and words in made-up values.
CREDENTIAL = ["access", "api", "auth", "bearer", "client_secret", "credential", "key", "passwd", "password", "private", "pwd", "secret", "token"]
OTHER = ["build", "checksum", "commit", "digest", "etag", "guid", "hash", "id", "image", "invoice", "isbn", "md5", "order", "phone", "ref", "request", "revision", "sha", "sha1", "sha256", "tracking", "uuid", "version"]
DICTIONARY = [
    "account", "admin", "alpha", "backup", "beta", "build", "change", "client", "config", "data", "default", "demo", "dev", "document", "dummy", "example", "fake", "file", "here", "image",
    "index", "input", "insert", "item", "key", "line", "list", "local", "main", "model", "module", "name", "network", "number", "object", "output", "page", "password", "path", "placeholder",
    "product", "project", "release", "report", "sample", "secret", "server", "service", "session", "source", "stage", "string", "system", "table", "temp", "test", "text", "time", "token", "train",
    "update", "upload", "user", "value", "version", "view", "web", "window", "your",
]

FEATURES = ["length", "digits", "upper", "lower", "symbols", "transitions", "kinds", "hex_only", "dictionary", "slashes", "dashes", "path_before", "assigned", "quoted", "credential_before", "other_before", "prefix", "vowels", "marks", "reference"]
_FINDING = "value string, before string, after string, label double"


def features(value: Column, before: Column, after: Column) -> dict[str, Column]:
    n = F.greatest(F.length(value), F.lit(1))
    share = lambda pattern: (n - F.length(F.regexp_replace(value, pattern, ""))) / n
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "-")
    runs = F.length(F.regexp_replace(shape, r"(.)\1*", "x"))
    low = F.lower(before)
    among = lambda words: low.rlike(rf"(?<![a-z])(?:{'|'.join(words)})(?![a-z])").cast("double")
    return {
        "length": n.cast("double"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "transitions": runs / n,
        "kinds": F.size(F.array_distinct(F.split(value, ""))) / n,
        "hex_only": value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "dictionary": (n - F.length(F.regexp_replace(F.lower(value), "|".join(DICTIONARY), ""))) / n,
        "slashes": share("/"),
        "dashes": share("[-_]"),
        "path_before": (before.rlike(r"[/\\.@]$|://\S*$") | after.rlike(r"^[/\\.@]")).cast("double"),
        "assigned": before.rlike(r"[=:]\s*[\"']?$").cast("double"),
        "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("double"),
        "credential_before": among(CREDENTIAL),
        "other_before": among(OTHER),
        "prefix": value.rlike("^(?:AKIA|ASIA|gh[pousr]_|sk[-_]|xox[abp]-|eyJ|AIza|glpat-|-----BEGIN )").cast("double"),
        "vowels": share("[aeiouAEIOU]"),
        "marks": share("[^A-Za-z0-9/_.-]"),
        "reference": value.rlike(r"[({$].*[)}]|^\$|^%|^\.|::|^[A-Za-z_]+(?:\.[A-Za-z_]+)+$|^[*x.]+$").cast("double"),
    }


def labelled(per_kind: int = 60, seed: int = 11) -> list[dict]:
    """Labelled findings by rule: per_kind of each kind."""
    rng = random.Random(seed)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    digit, low, up = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = lambda: rng.choice(DICTIONARY)
    text = lambda: " ".join(pick(low, rng.randint(2, 8)) for _ in range(rng.randint(0, 5)))

    def named(words):
        name = rng.choice(words)
        name = rng.choice([name, name.upper(), f"db_{name}", f"{name}s", f"my-{name}"])
        return name + rng.choice(["=", ": ", ' = "', "='", ":"])

    def other():
        return rng.choice([lambda: f"{rng.choice(OTHER)} ", lambda: f"{rng.choice(OTHER)}: ", lambda: named(OTHER)])()

    yes = [
        lambda: ("AKIA" + pick(up + digit, 16), rng.choice([text() + " ", named(["access_key", "key", "api"])])),
        lambda: (pick("0123456789abcdef", rng.choice([18, 20, 32, 40, 64])), text() + " " + named(CREDENTIAL)),
        lambda: (pick("0123456789ABCDEF", rng.choice([18, 32, 40])), text() + " " + named(CREDENTIAL).upper()),
        lambda: (pick(low + up + digit, rng.randint(16, 48)), named(CREDENTIAL)),
        lambda: (rng.choice(["ghp_", "sk-", "sk_live_", "xoxb-", "AIza"]) + pick(low + up + digit, rng.randint(24, 40)), rng.choice([text() + " ", named(CREDENTIAL)])),
        lambda: (base64.b64encode(rng.randbytes(rng.choice([24, 32, 48]))).decode(), named(CREDENTIAL)),
        lambda: (pick(low + up + digit, rng.randint(20, 40)), rng.choice(["Authorization: Bearer ", "bearer ", "auth "])),
        lambda: (pick(low + up + digit + "!#$%&*+=?@^~", rng.randint(9, 24)), named(CREDENTIAL)),
        lambda: (pick(low, rng.randint(12, 24)), named(CREDENTIAL)),
        lambda: ("eyJ" + pick(low + up + digit, rng.randint(16, 60)) + "." + pick(low + up + digit + "-_", rng.randint(20, 80)) + "." + pick(low + up + digit + "-_", 43), rng.choice([text() + " ", named(CREDENTIAL), "Authorization: Bearer "])),
        lambda: (pick(low + up + digit, rng.randint(8, 20)), rng.choice(["https", "postgres", "amqp", "ftp"]) + "://" + pick(low, rng.randint(3, 8)) + ":"),
        lambda: ("-----BEGIN " + rng.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]) + "PRIVATE KEY-----", rng.choice(["", "\n", text() + "\n"])),
    ]
    no = [
        lambda: (str(uuid.UUID(int=rng.getrandbits(128))), rng.choice([text() + " ", other()])),
        lambda: (pick("0123456789abcdef", rng.choice([32, 40, 64])), other()),
        lambda: (pick(digit, rng.randint(12, 20)), rng.choice([text() + " ", other(), named(["number", "card", "iban"])])),
        lambda: ("/".join([word(), word(), word() + pick(digit, 2), word()]), rng.choice(["/", "https://host.org/", "./", text() + " "])),
        lambda: (f"{word()}-{word()}-{pick(digit, 3)}-{word()}", rng.choice([text() + " ", named(CREDENTIAL), other()])),
        lambda: (f"your_{word()}_here_{pick(digit, 2)}", named(CREDENTIAL)),
        lambda: (f"20{pick(digit, 2)}-{pick('01', 2)}-{pick('012', 2)}T{pick('01', 2)}-{pick(digit, 2)}", text() + " "),
        lambda: (pick(low, rng.randint(12, 20)) + pick(digit, 1), text() + " "),
        lambda: (word() + word().capitalize() + word().capitalize() + pick(digit, 1), rng.choice([text() + " ", "def ", "import "])),
        lambda: (pick(digit, 4) + "-" + pick(digit, 4) + "-" + pick(digit, 4), text() + " "),
        lambda: (rng.choice(["${%s_%s}", "os.environ[%s_%s]", "config.%s.%s", "get_%s(%s)", "{{%s.%s}}", "$%s_%s", "%s::%s"]) % (word(), word()), named(CREDENTIAL)),
        lambda: (word() + rng.choice("-_.") + word() + rng.choice(["", rng.choice("-_.") + word()]), named(CREDENTIAL)),
        lambda: (rng.choice(["*", "x", "."]) * rng.randint(8, 16), named(CREDENTIAL)),
        lambda: ("".join(rng.choice(["ba", "de", "ki", "lo", "mu", "ner", "sta", "tion", "ing", "ver", "ous", "al"]) for _ in range(rng.randint(3, 5))), rng.choice(["the key: ", "token: ", "secret: ", "a token = ", "key="])),
    ]
    out = []
    for label, kinds in ((1.0, yes), (0.0, no)):
        for make in kinds:
            for _ in range(per_kind):
                value, before = make()
                after = before[-1] if before[-1:] and before[-1] in "\"'" else rng.choice(["", " ", "\n"])
                out.append({"value": value, "before": (text() + " " + before)[-BEFORE:], "after": after + text()[:AFTER], "label": label})
    return out


@dataclass
class SecretScan:
    """threshold: the forest's probability from which a finding is kept."""

    trees: int = 24
    depth: int = 7
    seed: int = 3
    threshold: float = 0.5

    def fit(self, spark: SparkSession, findings: DataFrame | None = None) -> RandomForestClassificationModel:
        """findings: value, before, after, label (1: a secret)."""
        if findings is None:
            made = F.from_json(F.lit(json.dumps(labelled())), f"array<struct<{_FINDING.replace(' string', ':string').replace(' double', ':double')}>>")
            findings = spark.range(0, 1, 1, 1).select(F.inline(made))
        rows = self._assembled(findings.coalesce(1))
        forest = RandomForestClassifier(numTrees=self.trees, maxDepth=self.depth, seed=self.seed, labelCol="label", featuresCol="vector")
        return forest.fit(rows)

    @staticmethod
    def _assembled(findings: DataFrame) -> DataFrame:
        made = features(F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))
        return VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(findings.withColumns(made))

    @staticmethod
    def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, start (code points before it), value, before, after of every candidate."""
        # \G: a match begins where the last one ended, so that the text after the last candidate is read once.
        around = rf"(?s)\G(.*?)({CANDIDATE})(?=(.{{0,{AFTER}}}))"
        d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(CANDIDATE))
        group = lambda k: F.regexp_extract_all("text", F.lit(around), F.lit(k))
        d = d.withColumn("row", F.monotonically_increasing_id())  # of the text, before its candidates become rows
        d = d.select("doc_id", "row", F.posexplode(F.arrays_zip(group(1).alias("gap"), group(2).alias("value"), group(3).alias("after"))).alias("at", "x"))
        d = d.select("doc_id", "row", "at", F.length("x.gap").alias("gap"), F.substring(F.col("x.gap"), -BEFORE, BEFORE).alias("before"), F.col("x.value").alias("value"), F.col("x.after").alias("after"))
        upto = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        start = F.sum(F.col("gap") + F.length("value")).over(upto) - F.length("value")
        return d.select("doc_id", start.cast("long").alias("start"), "value", "before", "after")

    def scored(self, docs: DataFrame, model: RandomForestClassificationModel | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Every candidate with the forest's probability, as score."""
        model = model or self.fit(docs.sparkSession)
        out = model.transform(self._assembled(self.candidates(docs, doc_id, text)))
        return out.withColumn("score", vector_to_array("probability")[1])

    def scan(self, docs: DataFrame, model: RandomForestClassificationModel | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, start, end, kind, value, score of the findings that are kept."""
        low = F.lower("before")
        kind = (
            F.when(F.col("value").rlike("^A[KS]IA[A-Z0-9]{16}$"), "access_key_id").when(low.rlike("passw|pwd"), "password")
            .when(low.rlike("token|bearer"), "token").when(low.rlike("key"), "key").otherwise("other")
        )
        kept = self.scored(docs, model, doc_id, text).where(F.col("score") >= self.threshold)
        return kept.select("doc_id", "start", (F.col("start") + F.length("value")).alias("end"), kind.alias("kind"), "value", "score")
