"""Secret scans with DataFrame functions only: candidates by pattern, false positives removed by a random forest.

Each text is split at its candidates; every candidate gets features of its length, character transitions, dictionary
coverage, path and neighbouring words, and the forest's trees, fitted on labelled findings, vote on it. The fitted
trees are arrays that a column expression walks through, so that scanning and redacting are one pass over the rows without a shuffle.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.decontam import let

#: What stands after a colon or an equals sign, in quotes or up to a space or the next item of a list, and any other run of at
#: least 16 characters that keys are made of. Equals signs belong to a run as padding only. A repeated group has no alternatives
#: inside, as those would be matched by one call within another for each character of a value.
CANDIDATE = "|".join(
    (
        r"""(?<=[:=] ?")[^\s"]{8,}(?=")""",
        r"""(?<=[:=] ?')[^\s']{8,}(?=')""",
        r"""(?<=[A-Za-z0-9_\])"'][:=] ?)(?!//|["'`])(?:(?![,;&](?:\s|$|["'`]?[A-Za-z0-9_.-]++["'`]?[=:]))[^\s"'`<>]){8,}(?<![.,;:)\]}])""",
        r"""(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=.-]))?""",
    )
)
MASK = "[secret]"
TREES, DEPTH, SEED = 24, 6, 7
#: Labelled findings made by rule where none are given.
FINDINGS = 5000
BEFORE, AFTER = 48, 24

# Words whose letters in a candidate speak against a secret.
DICTIONARY = (
    "about access account action address after again always answer assert author before begin between block branch bridge "
    "build bundle button change check child class client close cloud code collection color column command commit common "
    "component config connect container content context control count create current custom data database date default "
    "delete demo deploy description detail device directory document domain download dummy element email empty enable "
    "error event example export extension factory false feature field file filter find folder format frame function "
    "general generate group handler hello helper here history home image import index information input install instance "
    "interface internal item label language library license light limit line link list local login long main manager map "
    "master message method model module name network number object option order output package page parent password path "
    "placeholder plugin point port prefix process product profile project property provider public query question random "
    "read record release replace report request resource response result return sample script search section select "
    "server service session setting simple size source start state status string style submit system table target task "
    "template test text time title token total type undefined update upload user utils value version view web width "
    "window word world write your"
).split()
# Neighbouring words that speak for and against a secret.
FOR = r"(?i)(secret|token|passw|pwd|api.?key|apikey|access.?key|private.?key|auth|credential|bearer|signature)"
AGAINST = r"(?i)(sha\d*|md5|commit|hash|checksum|digest|integrity|uuid|guid|revision|etag|example|sample|placeholder|fixture|href|src|url|import|version)"

FEATURES = ("length", "transitions", "digits", "upper", "symbols", "distinct", "hex", "vowels", "words", "slashes", "dots", "path", "test_path", "near_for", "near_against", "assigned", "quoted")


def features(candidate: Column, before: Column, after: Column, path: Column) -> Column:
    """A struct of doubles; before and after are the characters around the candidate, path that of its file or null."""
    c, low = candidate, F.lower(candidate)
    size = F.length(c).cast("double")
    share = lambda pattern: (size - F.length(F.regexp_replace(c, pattern, ""))) / size
    turn = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    values = {
        "length": size,
        "transitions": (F.size(F.split(c, turn, -1)) - 1) / size,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "symbols": share("[A-Za-z0-9]") * -1.0 + 1.0,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
        "hex": share("[0-9a-fA-F]"),
        "vowels": share("[aeiouAEIOU]"),
        "words": (size - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))) / size,
        "slashes": size - F.length(F.replace(c, F.lit("/"), F.lit(""))),
        "dots": size - F.length(F.replace(c, F.lit("."), F.lit(""))),
        "path": flag(before.rlike(r"(://\S*|[/\\])$") | after.rlike(r"^[/\\]")),
        "test_path": flag(F.coalesce(path, F.lit("")).rlike(r"(?i)(test|example|sample|fixture|mock|docs?/)")),
        "near_for": flag(before.rlike(FOR)),
        "near_against": flag(before.rlike(AGAINST)),
        "assigned": flag(before.rlike(r"""[:=]\s*["']?$""")),
        "quoted": flag(before.rlike(r"""["']$""") & after.rlike(r"""^["']""")),
    }
    return F.struct(*(values[k].cast("double").alias(k) for k in FEATURES))


def labelled_findings(spark: SparkSession, n: int = FINDINGS, first: int = 0) -> DataFrame:
    """(before, candidate, after, path, label, kind) made by rule: keys in many formats, and what is often taken for one.

    Kinds 14 and 15 are keys in files of tests and examples, which are none. Finding i is always the same; other values of first give others."""
    noise = lambda salt: F.sha2(F.concat_ws(":", F.lit(salt), F.col("id").cast("string")), 512)
    pick = lambda salt, *options: F.element_at(F.array(*(o if isinstance(o, Column) else F.lit(o) for o in options)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(options))) + 1).cast("int"))
    base64 = lambda salt: F.regexp_replace(F.base64(F.unhex(noise(salt))), "=", "")
    words = F.split(F.lit(" ".join(DICTIONARY)), " ")  # one constant, not a node for each word wherever one is drawn
    word = lambda salt: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    syllables = ("er", "the", "ing", "an", "tion", "st", "en", "ou", "ble", "re", "ch", "mente", "keit", "ver", "aux", "lich")
    invented = F.concat(*(pick(f"s{i}", *syllables) for i in range(7)))
    short = F.concat(*(pick(f"t{i}", *syllables) for i in range(3)), F.lit("en"))
    cap = lambda s: F.initcap(word(s))
    secrets = (
        F.substr(noise("a"), F.lit(1), F.lit(40)), F.substr(noise("b"), F.lit(1), F.lit(32)), F.substr(noise("c"), F.lit(1), F.lit(64)),
        F.substr(base64("d"), F.lit(1), F.lit(40)), F.concat(F.lit("AKIA"), F.upper(F.substr(F.regexp_replace(base64("e"), "[+/]", "Q"), F.lit(1), F.lit(16)))),
        F.concat(F.lit("ghp_"), F.substr(F.regexp_replace(base64("f"), "[+/]", "x"), F.lit(1), F.lit(36))), F.concat(F.lit("sk_live_"), F.substr(F.regexp_replace(base64("g"), "[+/]", "7"), F.lit(1), F.lit(24))),
        F.concat(F.lit("eyJ"), F.substr(base64("h"), F.lit(1), F.lit(60))), F.concat(F.substr(base64("i"), F.lit(1), F.lit(9)), pick("i2", "!", "#", "$9", "%"), F.substr(noise("i3"), F.lit(1), F.lit(4))),
    )
    part = lambda salt, n: F.substr(base64(salt), F.lit(1), F.lit(n))
    passwords = (
        F.concat(part("r1", 4), pick("r2", "$", "#", "!", "@"), part("r3", 6), pick("r4", "#", "%", "^", "&"), part("r5", 5), pick("r6", "!", "*x", "?7")),
        F.concat(word("r7"), F.substr(F.translate(noise("r8"), "abcdef", "012345"), F.lit(1), F.lit(2)), pick("r9", "!", "#", "$", "@"), F.substr(noise("r10"), F.lit(1), F.lit(4))),
        F.concat(F.substr(short, F.lit(1), F.lit(6)), pick("r11", "2!", "7#", "9$", "3@"), F.substr(noise("r12"), F.lit(1), F.lit(4))),
    )
    others = (
        invented, F.concat(invented, pick("t", "tion", "heit", "mente", "ing")), F.concat_ws("_", word("j1"), word("j2"), word("j3"), F.lit("value")), F.concat(word("k1"), cap("k2"), cap("k3"), cap("k4"), F.lit("Id")),
        F.concat_ws("/", F.lit("src"), word("l1"), word("l2"), F.concat(word("l3"), F.lit(".html"))), F.repeat(pick("m", "x", "0", "-", "=", "_", "ab"), 20), F.concat_ws("-", F.lit("your"), word("n1"), word("n2"), F.lit("here")),
        F.lit("0123456789abcdef"), F.concat_ws(".", F.lit("www"), word("o1"), word("o2"), F.lit("example.com")), F.concat(F.lit("2024-01-"), F.substr(F.translate(noise("p"), "abcdef", "012345"), F.lit(1), F.lit(8))), F.upper(F.concat_ws("_", word("q1"), word("q2"), word("q3"))),
    )
    values = (
        F.rpad(short, 8, "e"), F.concat(short, pick("v1", "ing", "heit", "tion")), F.concat(word("v2"), F.lit("@"), word("v3"), F.lit(".com")), F.concat(F.lit("https://"), word("v4"), F.lit(".com/"), word("v5"), F.lit("?id="), word("v6")),
        F.concat_ws("-", F.lit("+49-30"), F.substr(F.translate(noise("v7"), "abcdef", "012345"), F.lit(1), F.lit(7))), F.concat(word("v8"), F.lit("("), word("v9"), F.lit(")")), F.concat(word("v10"), F.lit("."), word("v11"), F.lit("()")),
        F.concat_ws(",", word("v12"), word("v13"), word("v14")), F.concat(F.lit("${"), F.upper(word("v15")), F.lit("_VALUE}")), F.concat_ws("-", F.lit("your"), word("v16"), F.lit("here")), F.concat(F.lit("os.environ["), word("v17"), F.lit("]")),
        F.concat(F.lit("data:image/"), pick("v18", "png", "gif", "jpeg"), F.lit(";base64,"), base64("v19"), pick("v20", "", base64("v21"), F.concat(base64("v22"), base64("v23")))),
    )
    name = F.concat_ws("_", word("n5"), word("n6"), pick("n7", "secret", "access", "private", "client"), pick("n8", "api_key", "key", "token", "auth_token", "password"))
    prose = (invented, F.initcap(invented), F.upper(invented), F.concat(invented, F.lit(".")), F.concat(F.initcap(invented), F.lit(".")), F.concat(invented, F.lit("."), F.substr(F.translate(noise("w1"), "abcdef", "012345"), F.lit(1), F.lit(2))), F.substr(F.translate(noise("w2"), "abcdef", "012345"), F.lit(1), F.lit(16)))
    hashes = (F.substr(noise("u"), F.lit(1), F.lit(40)), F.substr(noise("v"), F.lit(1), F.lit(64)), F.concat_ws("-", F.substr(noise("w"), F.lit(1), F.lit(8)), F.substr(noise("w"), F.lit(9), F.lit(4)), F.substr(noise("w"), F.lit(13), F.lit(4)), F.substr(noise("w"), F.lit(17), F.lit(12))))
    named = F.concat(word("x1"), pick("x2", " ", ". ", ", "), pick("x3", "token", "secret_key", "password", "api_key", "access_key", "auth_token"), pick("x4", " = ", "=", ": "), pick("x5", '"', "'", ""))
    plain = F.concat(word("y1"), F.lit(" "), word("y2"), pick("y3", " ", ". ", ", ", " | ", ' = "', ": "))
    summed = F.concat(word("z1"), pick("z2", " commit ", " sha256:", " md5 = ", " checksum: ", ' integrity="', " uuid "))
    keyed = F.concat(word("x6"), pick("x7", " ", ". ", "; "), pick("x8", "API_KEY", "AUTH_TOKEN", "DB_PASSWORD", "CLIENT_SECRET", "export ACCESS_KEY", "passwd"), pick("x9", "=", "=", ": ", "= "))
    assigned = F.concat(word("y4"), F.lit(" "), word("y5"), pick("y6", "=", ": ", " = ", ':"', ' = "'))
    kind = F.pmod(F.xxhash64("id", F.lit("kind")), F.lit(16))
    made = lambda before, candidate, label: F.struct(before.alias("before"), candidate.alias("candidate"), F.lit(label).alias("label"))
    secret, mixed = lambda before: made(before, pick("secret", *secrets), 1.0), lambda before, label: made(before, pick("secret", *secrets, *passwords), label)
    rows = {
        (0, 1, 2, 3): secret(named),
        (4,): made(summed, pick("hash", *hashes), 0.0),
        (5,): made(named, pick("other", *others[2:]), 0.0),
        (6,): mixed(keyed, 1.0),
        (7,): made(named, pick("secret", *passwords), 1.0),
        (8,): made(plain, pick("secret", *secrets[3:8]), 1.0),  # without a word that names them
        (9,): made(assigned, pick("value", *values), 0.0),
        (10,): made(F.when(F.xxhash64("id", F.lit("of")) % 3 == 0, keyed).otherwise(plain), pick("other", *others, *values[8:], name, F.upper(name)), 0.0),
        (12, 13): made(plain, pick("prose", *prose), 0.0),
        (14,): made(named, pick("secret", *secrets), 0.0),
        (15,): mixed(keyed, 0.0),
        (11,): made(plain, pick("other", *others, *values, name, F.upper(name), F.concat(F.lit("my_"), name), F.upper(F.concat(F.lit("my_"), name))), 0.0),
    }
    file = F.concat(word("p1"), pick("p2", ".py", ".yaml", ".env", ".js", ".json", ".txt"))
    usual = pick("p3", F.concat(F.lit("src/"), file), F.concat(word("p4"), F.lit("/"), file), F.concat(F.lit("deploy/config/"), file), file, F.lit(None).cast("string"), F.lit(None).cast("string"))
    trial = F.concat(pick("p5", "tests/", "src/tests/", "examples/", "spec/fixtures/", "docs/", "mocks/"), file)
    path = F.when((kind >= 14) | (F.xxhash64("id", F.lit("p6")) % 5 == 0) & (F.col("r.label") == 0), trial).otherwise(usual)
    # a plan for each kind: one condition over all of them is a tree that the planner's memory feels
    some = [spark.range(first, first + n, 1, 1).filter(kind.isin(*kinds)).select("id", row.alias("r")).select("id", "r.*", path.alias("path"), kind.alias("kind")) for kinds, row in rows.items()]
    after = F.when(F.col("before").rlike("[\"']$"), F.lit('" ')).otherwise(F.lit(" ")).alias("after")
    return reduce(DataFrame.unionByName, some).coalesce(1).sortWithinPartitions("id").select("before", "candidate", "label", after, "path", "kind")


def _flat(lines: list[str], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, threshold, vote) of one tree in the form that the library prints, as a full tree: node i has the children 2 i + 1 and 2 i + 2.

    A leaf above the last level is a node that sends everything to the left."""
    feature, threshold, vote = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, np.inf), np.zeros(2**depth)

    def put(i: int) -> None:
        line = lines.pop(0).strip()
        if m := re.match(r"Predict: (\S+)", line):
            while i < len(feature):
                i = 2 * i + 1
            vote[i - len(feature)] = float(m[1])
            return
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        feature[i], threshold[i] = int(m[1]), float(m[2])
        put(2 * i + 1)
        lines.pop(0)
        put(2 * i + 2)

    put(0)
    return feature, threshold, vote


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """A function from a struct of features to the share of trees that vote for a secret, with the forest in .model. Null labels teach nothing.

    findings: before, candidate, after, path, label (0 or 1). They are written first, as every feature reads them and the fit does so several times."""
    findings = written(findings.filter(F.col("label").isNotNull() & (F.length("candidate") > 0)).select("before", "candidate", "after", "path", F.col("label").cast("double")), "findings")
    rows = findings.select("label", features(F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.col("path")).alias("f"))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.select("label", "f.*").coalesce(1))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)
    printed = [x.splitlines()[1:] for x in re.split(r"\n\s+Tree \d+", model.toDebugString)[1:]]
    flat = [_flat([x for x in lines if x.strip()], depth) for lines in printed]
    nodes, leaves = 2**depth - 1, 2**depth
    feature, threshold, vote = (F.lit(np.concatenate([t[i] for t in flat])) for i in range(3))

    def votes(f: Column) -> Column:
        def walk(x: Column) -> Column:
            step = lambda k: lambda n, _: 2 * n + F.when(F.get(x, F.get(feature, k * nodes + n)) <= F.get(threshold, k * nodes + n), 1).otherwise(2)
            leaf = lambda k: F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step(k)) - nodes
            return F.aggregate(F.sequence(F.lit(0), F.lit(len(flat) - 1)), F.lit(0.0), lambda s, k: s + F.get(vote, k * leaves + leaf(k))) / len(flat)

        return let(F.array(*(f[name] for name in FEATURES)), walk)

    votes.model = model
    return votes


def scanned(text: Column, votes, path: Column | None = None, candidate: str = CANDIDATE) -> Column:
    """(gaps, found): what stands between candidates, and for each (start from 0, secret, score). Null text is an empty one."""
    path = F.lit(None).cast("string") if path is None else path
    text = F.coalesce(text, F.lit(""))
    block = 512

    def rate(b: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            # the name of a key may be a candidate itself
            before, after = F.concat(*(F.coalesce(F.right(x, F.lit(BEFORE)), F.lit("")) for x in (F.get(b["matches"], i - 1), F.get(b["gaps"], i)))), F.get(b["gaps"], i + 1)
            f = features(c, F.right(before, F.lit(BEFORE)), F.left(after, F.lit(AFTER)), path)
            return F.struct(c.alias("secret"), let(f, votes).alias("score"))

        sizes = F.transform(b["matches"], lambda c, i: (F.length(F.get(b["gaps"], i)) + F.length(c)).cast("long"))

        def placed(s: Column) -> Column:  # running sums by blocks, so that long lists cost no square
            total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)
            blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / block).cast("int")), lambda k: total(F.slice(s, k * block + 1, block)))
            bases = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda a, y: F.concat(a, F.array(F.element_at(a, -1) + y)))
            start = lambda i, z: F.get(z, F.floor(i / block).cast("int")) + total(F.slice(s, F.floor(i / block).cast("int") * block + 1, i % block)) + F.length(F.get(b["gaps"], i))
            return let(bases, lambda z: F.transform(F.transform(b["matches"], one), lambda m, i: F.struct(start(i, z).alias("start"), m["secret"].alias("secret"), m["score"].alias("score"))))

        return F.struct(b["gaps"].alias("gaps"), let(sizes, placed).alias("found"))

    return let(F.struct(F.split(text, candidate, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(candidate), 0).alias("matches")), rate)


def secrets(docs: DataFrame, votes, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, start, length, secret, score): one row for each candidate that at least `least` of the trees take for a secret.

    Null and empty texts have none, repeated rows give repeated secrets, a null id stays null. path_col names the column with a document's file, if there is one."""
    found = docs.select(F.col(id_col).alias("doc_id"), scanned(F.col(text_col), votes, F.col(path_col) if path_col else None)["found"].alias("found"))
    found = found.select("doc_id", F.explode(F.filter("found", lambda x: x["score"] >= least)).alias("x"))
    return found.select("doc_id", "x.start", F.length("x.secret").cast("long").alias("length"), "x.secret", "x.score")


def redacted(docs: DataFrame, votes, least: float = 0.5, text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """docs with MASK in the place of every secret; all rows, columns and null texts stay."""
    both = scanned(F.col(text_col), votes, F.col(path_col) if path_col else None)
    clean = let(both, lambda b: F.concat(F.array_join(F.transform(b["found"], lambda x, i: F.concat(F.get(b["gaps"], i), F.when(x["score"] >= least, F.lit(MASK)).otherwise(x["secret"]))), ""), F.element_at(b["gaps"], -1)))
    return docs.select(*(F.when(F.col(c).isNotNull(), clean).alias(c) if c == text_col else F.col(c) for c in docs.columns))
