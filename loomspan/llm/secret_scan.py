"""Secret scans: candidate patterns, then a random forest that removes false positives.  Native.

Candidates come from one expression (private-key blocks, tokens of known shapes, passwords in
addresses, assignments to a telling name, long hexadecimal or base64 runs), in time linear in
the text: no part of it looks past the next candidate's begin.  A value goes up to its closing
quote, or to the white space, quote or separator that ends it, however long.  Each becomes a row of features: length, character transitions and classes,
distinct characters, dictionary coverage, the shape, and what the path and the words on
both sides say.  A random forest trained on labelled findings decides.

The forest is trained on the cluster by Spark's own JVM trainer and then walked as a
constant array of trees, so that scoring is an expression over the features inside the row:
no Python, no join and no shuffle.  Texts without a candidate stop at the first test.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, let, materialize, running

#: A key's body: base64 lines, the few header lines that key files have, line ends (escaped ones too).
#: Lines are long, so prose is none of it; the last may be short.  No part looks past another key's header.
_END = r"(?:\s|\\++[rn])"
_LINES = rf"""(?:{_END}*+(?:[A-Za-z0-9+/=]{{16,}}+|(?:Proc-Type|DEK-Info|Version|Comment|X-[A-Za-z-]{{1,30}}+):[ ]?+[!-~]{{1,160}}+))*+"""
_LAST = rf"""(?:{_END}*+(?:(?=[A-Za-z]*+[0-9+/=])[A-Za-z0-9+/=]{{1,15}}+|[A-Za-z]{{1,15}}+(?={_END}*+(?:-----END|(?![\s\S])))))?+"""
_LABEL = "[A-Z0-9 ]{0,24}PRIVATE KEY(?: BLOCK)?+-----"
PRIVATE_KEY = rf"-----BEGIN {_LABEL}{_LINES}{_LAST}(?:{_END}*+-----END {_LABEL})?+"
#: First letters of tokens that services hand out.
VENDORS = (
    "glpat- gloas- sk_live_ rk_live_ sk_test_ rk_test_ pk_live_ AIza npm_ pypi- SG\\. sk- hf_ dop_v1_ doo_v1_ shpat_ shpss_ ya29\\. "
    "github_pat_ sq0atp- sq0csp- hvs\\. xapp- rubygems_ lin_api_ dckr_pat_ figd_ ntn_ GOCSPX- AGE-SECRET-KEY-1"
).split()
#: Shapes that a value can have, in the order they are looked for.
KNOWN = (
    ("private_key", PRIVATE_KEY),
    ("cloud_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("forge_token", r"\bgh[pousr]_[A-Za-z0-9]{30,}+\b"),
    ("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}+"),
    ("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+"),
    ("vendor_token", rf"(?<![A-Za-z0-9_-])(?:{'|'.join(VENDORS)})[A-Za-z0-9_.-]{{16,}}+"),
)
#: A password in an address, behind the user's name.
URL_LEAD = r"""://[^\s/:@"'<>]{0,64}+:"""
URL_PASSWORD = rf"""{URL_LEAD}[^\s/@"'<>]{{3,256}}+(?=@[A-Za-z0-9\[])"""
#: A value behind a telling name: in quotes up to the closing one, else up to white space, a quote or
#: one of , ; < > ( ) [ ] { } | \ or the next parameter of a query.  Where the name says that it is a
#: password, it may have spaces in quotes.  A private key behind a name is a private key.
_WIDE = "\u00A1-\u024F"
_SIGN = f"[!#-%*-+./0-:=?-Z^_a-z~{_WIDE}-]"
BARE = rf"(?:{_SIGN}|&(?![A-Za-z0-9_.-]{{1,40}}=)){{8,}}+"
_IS = r"""["']?+\s{0,3}+(?:=>|:=|=|:)\s{0,3}+"""
NAME = r"(?i:key|token|secret|pass(?:word|wd|phrase)|pwd|auth|credentials?)" + _IS
PASS = r"(?i:pass(?:word|wd|phrase)?|pwd|secret)" + _IS
_QUOTED = rf""""[!#-~{_WIDE}]{{8,}}+(?=")|'[!-&(-~{_WIDE}]{{8,}}+(?=')"""
_SPACED = """"(?! )[ !#-~]{8,128}+(?=")|'(?! )[ -&(-~]{8,128}+(?=')"""
NAMED = rf"""(?:{PASS}(?:{_SPACED})|{NAME}(?!["']?-----BEGIN )(?:{_QUOTED}|["']?{BARE}))"""
RUNS = (
    ("hex", r"\b[A-Fa-f0-9]{32,}+\b"), ("base64", r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*+[0-9])[A-Za-z0-9+/]{40,}+={0,2}")
)
CANDIDATE = "|".join(f"(?:{x})" for x in (*(x for _, x in KNOWN), URL_PASSWORD, NAMED, *(x for _, x in RUNS)))
#: What stands before the value in a candidate of the last two kinds.
LEAD = rf"""^(?:{URL_LEAD}|(?:{NAME}|{PASS})["']?)"""
#: Words whose letters make a value readable: placeholders, field names, plain English.
WORDS = """example sample dummy changeme change placeholder password passwd secret token insert replace default
test testing demo fake your here value none null undefined todo user username admin root login account server
client service config setting public private local host localhost domain name email string number index table
column field object function method class module package version release build debug main master branch commit
hello world foo bar baz qwerty letmein welcome monkey dragon the and for with from this that have will would
there their what about which when make like time just know take people into year good some could them see other
than then now look only come over think also back after use two how our work first well way even new want any
these give day most""".split()
#: Neighbouring words that speak for and against.
FOR = r"(?i)(?<![a-z])(?:secret|token|passw|pwd|api.?key|credential|bearer|auth|private|access)"
AGAINST = r"(?i)(?<![a-z])(?:examples?|samples?|dummy|placeholder|fake|tests?|commits?|sha.?(?:1|256|512)|md5|checksums?|digest|hash(?:es)?|uuid|revision|etag|integrity)(?![a-z])"
TEST_PATH = r"(?i)(?:test|spec|example|sample|doc|fixture|mock|demo)"
FEATURES = (
    "length", "transitions", "distinct", "digits", "uppers", "hex", "coverage", "run", "sep", "signs", "spaces", "known",
    "named", "for", "against", "for_after", "against_after", "test_path",
)
NEIGHBOURHOOD = 48
TREES, DEPTH, SEED = 24, 8, 7
FINDINGS = 16_000
#: The trained forest: nested [feature number, threshold, left, right], a leaf is its probability.
FOREST = Path(__file__).with_name("secret_forest.json")
MASK = "[SECRET]"

_CLASSES = ("abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "0123456789", "a" * 26 + "A" * 26 + "0" * 10)


def features(value, before, after, shape, named, path):
    """An array of doubles, in the order of :data:`FEATURES`, from columns."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    classes = F.translate(value, *_CLASSES)
    count = lambda x: F.length(value) - F.length(F.regexp_replace(value, x, ""))
    low = F.lower(value)
    cols = {
        "length": n,
        "transitions": (F.length(F.regexp_replace(classes, r"(.)\1*+", "$1")) - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64.0)),
        "digits": count("[0-9]") / n,
        "uppers": count("[A-Z]") / n,
        "hex": count("[0-9a-fA-F]") / n,
        "coverage": (
            F.length(low) - F.length(F.regexp_replace(low, "|".join(sorted(WORDS, key=len, reverse=True)), ""))
        ) / n,
        "run": F.length(F.regexp_extract(value, r"((.)\2{3,}+)", 1)) / n,
        "sep": count("[_.-]") / n,
        "signs": count(r"[^A-Za-z0-9_.\s-]") / n,
        "spaces": count(r"\s") / n,
        "known": shape.isin([k for k, _ in KNOWN]),
        "named": named,
        "for": before.rlike(FOR),
        "against": before.rlike(AGAINST),
        "for_after": after.rlike(FOR),
        "against_after": after.rlike(AGAINST),
        "test_path": path.rlike(TEST_PATH),
    }
    return F.array(*[F.coalesce(cols[k].cast("double"), F.lit(0.0)) for k in FEATURES])


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """``(value, before, after, shape, named, path, label)``: findings labelled by construction.

    True and false ones share every shape and every kind of neighbourhood, so that no feature
    decides alone: known token shapes stand among the false ones (documented samples, masked
    and counted values, a key's header without a body), bare hexadecimal and base64 runs among
    the true ones, telling names before both.  A tenth of the neighbourhoods and paths are
    drawn regardless of the label.  Every row follows from its number; no document is used.
    """
    r = lambda k: F.xxhash64("id", F.lit(k))
    at = lambda k, m: F.pmod(r(k), F.lit(m)).cast("int")
    pick = lambda k, *options: F.element_at(F.array(*map(F.lit, options)), at(k, len(options)) + 1)
    some = lambda k: F.sha2(F.concat(F.lit(k), F.col("id").cast("string")), 512)
    # drawn once a row, as columns: what follows only refers to them
    drawn = ("a", "b", "c", "d", "e", "f", "g", "h", "p1", "p3", "p5", "w1", "w2", "w3", "w4", *[f"q{k}" for k in range(6)])
    rows = spark.range(n).withColumns(
        {
            "label": (F.col("id") % 2).cast("double"), "hexes": some("h"),
            "b64": F.translate(F.concat(F.base64(F.unhex(some("b"))), F.base64(F.unhex(some("c")))), "=\r\n", ""),
        }
        | {f"w_{k}": pick(k, *WORDS) for k in drawn}
    ).withColumns({"alnum": F.translate("b64", "+/", "xQ"), "letters": F.translate("hexes", "0123456789", "ghijklmnop")})
    hexes, b64, alnum, letters = map(F.col, ("hexes", "b64", "alnum", "letters"))
    cut = lambda s, k, *sizes: F.substring(s, F.lit(1), pick(k, *sizes).cast("int"))
    word = lambda k: F.col(f"w_{k}")
    caps = F.upper(alnum)
    web = F.concat(
        F.lit("eyJ"), F.substring(alnum, 1, 30), F.lit("."), F.substring(alnum, 31, 60), F.lit("."),
        F.substring(alnum, 91, 43),
    )
    chat = F.concat(F.lit("xoxb-"), at("d1", 10**9).cast("string"), F.lit("-"), F.substring(alnum, 1, 24))
    key = lambda body: F.concat(
        F.lit("-----BEGIN "), pick("kk", "", "RSA ", "EC ", "OPENSSH "), F.lit("PRIVATE KEY-----"), body
    )
    line_end = pick("le", "\n", "\\n", "\r\n")
    body = F.concat(
        line_end,
        F.substring(
            F.repeat(F.concat(b64, line_end), F.lit(80)), F.lit(1),
            pick("kn", 12, 40, 64, 130, 400, 1600, 12000).cast("int"),
        ),
        F.when(at("end", 4) > 0, F.concat(line_end, F.lit("-----END PRIVATE KEY-----"))).otherwise(""),
    )
    sign = lambda k: pick(k, "!", "#", "$", "@", "%", "^", "&", "*", "?", "+")
    digit = lambda k: at(k, 10).cast("string")
    vendor = pick("vn", *[v.replace("\\", "") for v in VENDORS])
    # a password as people make them, and one as machines do
    made = F.when(
        at("pw", 2) == 0,
        F.concat(F.initcap(word("p1")), digit("p2"), F.initcap(word("p3")), sign("p4"), F.initcap(word("p5")), digit("p6")),
    ).otherwise(
        F.concat(F.substring(alnum, 1, 4), sign("p4"), F.substring(alnum, 5, 5), sign("p7"), cut(F.substring(alnum, 10, 40), "p8", 1, 4, 9))
    )
    phrase = F.concat_ws(" ", *[F.substring(letters, 1 + 9 * k, 4 + k % 4) for k in range(4)])
    # value, shape, named (1: behind a telling name, 0: bare, null: drawn)
    true = (
        (made, None, 1), (phrase, None, 1),
        (F.concat(vendor, cut(alnum, "n", 20, 24, 32, 36, 40)), "vendor_token", None),
        (F.when(at("up", 2) == 0, made).otherwise(cut(alnum, "n", 8, 10, 12, 16, 20)), "url_password", 0),
        (cut(hexes, "n", 12, 16, 20, 24, 32, 40, 64, 128), None, 1),
        (cut(alnum, "n", 10, 12, 16, 20, 24, 32, 40, 64), None, 1), (cut(b64, "n", 24, 40, 44, 64, 88), None, 1),
        (F.concat(cut(alnum, "n", 8, 10, 12), pick("s", "-", "_", "."), cut(hexes, "m", 4, 6, 8)), None, 1),
        (F.concat(pick("ak", "AKIA", "ASIA"), F.substring(caps, 1, 16)), "cloud_key", None),
        (F.concat(pick("gh", "ghp_", "gho_", "ghs_"), cut(alnum, "n", 36, 40)), "forge_token", None),
        (chat, "chat_token", None), (web, "web_token", None), (key(body), "private_key", 0),
        (cut(hexes, "n", 32, 40, 64), "hex", 0), (cut(b64, "n", 40, 44, 64, 88), "base64", 0),
    )
    false = (
        (F.concat_ws("_", word("a"), word("b"), word("c")), None, 1),
        (F.concat_ws(" ", *[word(f"q{k}") for k in range(6)]), None, 1),
        (
            F.when(at("g", 3) == 0, F.concat(F.lit("$"), F.upper(word("a")), F.lit("_"), F.upper(word("b")))).when(
                at("g", 3) == 1, F.concat(F.lit("%"), F.upper(word("a")), F.upper(word("b")), F.lit("%"))
            ).otherwise(F.repeat(pick("c", "*", "?", "#", "."), at("m", 16) + 8)),
            None, 1,
        ),
        (
            F.concat(
                vendor,
                F.when(at("g", 2) == 0, F.repeat(pick("c", "x", "0", "X", "1"), at("m", 20) + 16)).otherwise(
                    F.concat(pick("q", "your_", "my-", "insert_", "an-"), word("a"), F.lit("_"), word("b"), F.lit("-"), word("c"), F.lit("_here"))
                ),
            ),
            "vendor_token", None,
        ),
        (
            pick("u", "password", "pass", "secret", "changeme", "PASSWORD", "xxxxxx", "your_password", "$DB_PASS", "***", "admin", "root", "postgres"),
            "url_password", 0,
        ),
        (
            F.concat(
                pick("p", "your_", "my-", "insert-", "example_"), word("a"), pick("q", "_here", "-value", "", "123")
            ),
            None, 1,
        ),
        (F.concat_ws(".", word("a"), word("b"), word("c"), word("d")), None, 1),
        (F.repeat(pick("c", "x", "0", "a", "X", "ab", "1234"), at("m", 20) + 8), None, 1),
        (
            F.concat(
                pick("ak", "AKIA", "ASIA"), F.substring(caps, 1, 9),
                pick("e", "EXAMPLE", "XXXXXXX", "0000000", "SAMPLEX"),
            ),
            "cloud_key", None,
        ),
        (
            F.concat(
                F.lit("ghp_"),
                F.when(at("g", 2) == 0, F.repeat(pick("c", "x", "0", "a", "X"), F.lit(36))).otherwise(
                    F.rpad(
                        F.concat(word("a"), word("b"), word("c"), word("d"), word("e"), word("f"), word("g")), 36,
                        "example",
                    )
                ),
            ),
            "forge_token", None,
        ),
        (
            F.concat(
                F.lit("xoxb-"),
                F.when(
                    at("g", 2) == 0, F.concat_ws("-", F.lit("your"), word("a"), word("b"))
                ).otherwise(F.repeat(pick("c", "x", "0", "1"), F.lit(20))),
            ),
            "chat_token", None,
        ),
        (
            F.concat(
                F.lit("eyJ"), F.repeat(word("a"), F.lit(4)), F.lit("."), F.repeat(word("b"), F.lit(4)), F.lit("."),
                F.repeat(word("c"), F.lit(3)),
            ),
            "web_token", None,
        ),
        (key(F.lit("")), "private_key", 0),
        (
            F.when(
                at("g", 4) == 0,
                F.substring(F.lit("0123456789abcdef" * 4), F.lit(1), pick("n", 32, 40, 48, 64).cast("int")),
            ).otherwise(cut(hexes, "n", 32, 40, 64, 128)),
            "hex", None,
        ),
        (
            F.when(at("g", 2) == 0, cut(b64, "n", 44, 64, 88)).otherwise(
                F.concat_ws(
                    "/", word("a"), word("b"), word("c"), word("d"), word("e"), word("f"), word("g"),
                    F.concat(word("h"), F.lit("2")),
                )
            ),
            "base64", 0,
        ),
    )
    is_true = F.col("label") == 1
    named_true, named_false = at("nt", 2) == 1, at("nf", 2) == 1

    def chosen(options, field):
        out = None
        for i, o in enumerate(options):
            v = o[field] if not isinstance(o[field], (str, int, type(None))) else F.lit(o[field])
            out = F.when(
                at("kind", len(options)) == i, v
            ) if out is None else out.when(at("kind", len(options)) == i, v)
        return out

    rows = rows.withColumns(
        {
            "value": F.when(is_true, chosen(true, 0)).otherwise(chosen(false, 0)),
            "shape": F.when(is_true, chosen(true, 1).cast("string")).otherwise(chosen(false, 1).cast("string")),
            "named": F.when(is_true, F.coalesce(chosen(true, 2).cast("boolean"), named_true)).otherwise(
                F.coalesce(chosen(false, 2).cast("boolean"), named_false)
            ),
        }
    )
    shape, named = F.col("shape"), F.col("named")
    name = pick(
        "name", "token =", "api_key:", "SECRET_KEY=", "password =", "auth_token:", "access token =", "key:", "pwd="
    )
    telling = pick(
        "fw", "the secret is", "api key", "bearer", "use this token", "access credential", "password follows", ""
    )
    sums = pick(
        "aw", "commit", "sha256:", "md5 checksum", "revision", "file digest", "integrity sha512", "example", "etag"
    )
    plain = F.concat_ws(" ", word("w1"), word("w2"))
    bare = shape.isin("hex", "base64")
    odd = at("odd", 10) == 0  # the neighbourhood says nothing here
    side = at("side", 2) == 0  # the telling words stand before, or behind
    says = F.when(odd, plain).when(
        is_true, F.when(bare, F.when(telling == "", F.lit("credential")).otherwise(telling)).otherwise(telling)
    ).otherwise(F.when(bare, sums).otherwise(pick("ow", "example", "sample value", "", "placeholder", "fake", "")))
    before = F.concat_ws(" ", plain, F.when(side, says), F.when(named, name))
    after = F.concat_ws(" ", F.when(~side, says), word("w3"), word("w4"))
    path = F.when(
        at("t", 10) < F.when(is_true, 1).otherwise(3), pick("path", "tests/unit.txt", "docs/example.md")
    ).otherwise(pick("path2", "src/app.txt", "web/page", "mail", ""))
    return rows.select(
        "value", before.alias("before"), after.alias("after"), F.coalesce(shape, F.lit("assignment")).alias("shape"),
        "named", path.alias("path"), "label",
    )


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list:
    """Forest as nested tuples: (feature number, threshold, left, right) or a leaf's probability.

    ``findings``: see :func:`labelled_findings`.  The trainer is Spark's; only the trees, a few
    thousand numbers, come to the driver.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    f = features(*map(F.col, ("value", "before", "after", "shape", "named", "path")))
    # the features are computed once, by all tasks; the order of the few rows that the trainer sees is fixed
    rows = materialize(findings.select(f.alias("f"), "label"), "findings")
    data = rows.repartition(1).sortWithinPartitions("f", "label").select(
        array_to_vector("f").alias("features"), "label"
    )
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(data)

    def walk(node):
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return round(stats[1] / sum(stats), 6) if len(stats) > 1 and sum(stats) else 0.0
        split = node.split()
        return (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()))

    grown = [walk(t._call_java("rootNode")) for t in model.trees]
    discard(rows)
    return grown


def trained() -> list:
    """The forest that lies beside this module, as :func:`train` grew it from :func:`labelled_findings`.

    ``python -m loomspan.llm.secret_scan`` trains it anew and writes it.
    """
    def nested(t):
        return (t[0], t[1], nested(t[2]), nested(t[3])) if isinstance(t, list) else t

    return [nested(t) for t in json.loads(FOREST.read_text())["trees"]]


def forest(trees: list, f):
    """The trees' mean probability over an array of features, rounded to 9 places.

    The trees are one constant array of flat nodes: feature (-1: a leaf), threshold or the
    leaf's probability, and where to go on.
    """

    def flat(tree):
        nodes: list = []

        def add(t):
            place = len(nodes)
            nodes.append(None)
            nodes[place] = {
                "f": t[0], "v": t[1], "l": add(t[2]), "r": add(t[3])
            } if isinstance(t, tuple) else {"f": -1, "v": t, "l": place, "r": place}
            return place

        add(tree)
        return nodes

    depth = lambda t: 1 + max(depth(t[2]), depth(t[3])) if isinstance(t, tuple) else 0
    steps = F.sequence(F.lit(1), F.lit(max([1, *map(depth, trees)])))
    book = F.from_json(F.lit(json.dumps([flat(t) for t in trees])), "array<array<struct<f:int,v:double,l:int,r:int>>>")

    def walk(total, nodes):
        down = lambda at, _: F.when(F.get(nodes, at)["f"] < 0, at).when(
            F.get(f, F.get(nodes, at)["f"]) <= F.get(nodes, at)["v"], F.get(nodes, at)["l"]
        ).otherwise(F.get(nodes, at)["r"])
        return total + F.get(nodes, F.aggregate(steps, F.lit(0), down))["v"]

    return F.round(F.aggregate(book, F.lit(0.0), walk) / len(trees), 9)


def candidates_of(text, path):
    """Array of (start, gap, lead, value, shape, named, f) of a text column; null where there is none.

    ``gap`` is the text since the previous candidate, ``lead`` what stands before the value
    (the name of an assignment).  ``start`` is a code point offset.  Built from whole arrays in
    k log k steps for k candidates.
    """
    found = F.struct(
        F.split(text, CANDIDATE, -1).alias("gap"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("hit")
    )
    sizes = lambda x: F.zip_with(
        x["gap"], x["hit"], lambda g, h: (F.length(g) + F.coalesce(F.length(h), F.lit(0))).cast("int")
    )
    sums = lambda x: let(sizes(x), lambda v: running(v, lambda earlier, here: F.coalesce(earlier, F.lit(0)) + here))

    def zipped(x):
        """What each candidate needs of itself and of its neighbours."""
        n = F.size(x["hit"])
        return F.arrays_zip(
            F.slice(x["gap"], F.lit(1), n).alias("gap"), x["hit"].alias("hit"),
            F.slice(x["gap"], F.lit(2), n).alias("next_gap"), F.slice(sums(x), F.lit(1), n).alias("end"),
            F.concat(F.array(F.lit("")), F.slice(x["hit"], F.lit(1), n - 1)).alias("last"),
            F.concat(F.slice(x["hit"], F.lit(2), n), F.array(F.lit(""))).alias("next"),
        )

    fields = ("gap", "hit", "next_gap", "end", "last", "next")
    named = F.transform(
        let(found, zipped),
        lambda z: F.struct(*[z[k].alias(k) for k in fields], z["hit"].rlike(LEAD).alias("led")),
    )
    # only the two kinds that are found by what leads to them begin with it
    value = lambda z: F.when(z["led"], F.regexp_replace(z["hit"], LEAD, "")).otherwise(z["hit"])
    valued = F.transform(
        named,
        lambda z: F.struct(
            *[z[k].alias(k) for k in fields], (z["led"] & ~F.startswith(z["hit"], F.lit("://"))).alias("named"),
            value(z).alias("value"),
        ),
    )

    def shape_of(z):
        out = None
        for name, x in KNOWN:
            there = z["value"].rlike(rf"^(?:{x})$")
            out = F.when(there, name) if out is None else out.when(there, name)
        return out.when(z["named"], "assignment").when(F.startswith(z["hit"], F.lit("://")), "url_password").when(
            z["value"].rlike(f"^(?:{RUNS[0][1]})$"), "hex"
        ).otherwise("base64")

    shaped = F.transform(
        valued, lambda z: F.struct(*[z[k].alias(k) for k in (*fields, "named", "value")], shape_of(z).alias("shape"))
    )
    tail = lambda s: F.substring(s, -NEIGHBOURHOOD, NEIGHBOURHOOD)
    head = lambda s: F.substring(s, 1, NEIGHBOURHOOD)

    def described(z):
        lead = F.substring(z["hit"], F.lit(1), F.length(z["hit"]) - F.length(z["value"]))
        before = F.concat(tail(F.concat(tail(z["last"]), tail(z["gap"]))), lead)
        after = head(F.concat(head(z["next_gap"]), head(z["next"])))
        return F.struct(
            (z["end"] - F.length(z["value"])).alias("start"), z["gap"].alias("gap"), lead.alias("lead"),
            z["value"].alias("value"), z["shape"].alias("shape"), z["named"].alias("named"),
            features(z["value"], before, after, z["shape"], z["named"], path).alias("f"),
        )

    return F.when(text.rlike(CANDIDATE), F.transform(shaped, described))


def with_findings(
    docs: DataFrame, trees: list, text_col: str = "text", path_col: str = "source", name: str = "__findings"
) -> DataFrame:
    """``docs`` and a column of all its candidates with their probabilities (null or empty: none)."""
    found = candidates_of(F.col(text_col).cast("string"), F.coalesce(F.col(path_col).cast("string"), F.lit("")))
    return docs.withColumn(
        name,
        F.transform(
            found,
            lambda h: F.struct(
                *[h[k].alias(k) for k in ("start", "gap", "lead", "value", "shape", "named")],
                forest(trees, h["f"]).alias("probability"),
            ),
        ),
    )


def scan(
    docs: DataFrame, trees: list, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source"
) -> DataFrame:
    """One row per candidate: ``(id, start, length, shape, named, value_sha256, probability, secret)``.

    ``start`` is a code point offset.  Values leave as digests only.  Null and empty texts
    have no candidates; a null path says nothing.  Repeated rows give repeated findings.
    """
    src = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(path_col).alias("path")
    )
    rows = with_findings(src, trees, "text", "path", "found").select("id", F.explode("found").alias("x"))
    return rows.select(
        "id", F.col("x.start").cast("long").alias("start"), F.length("x.value").cast("long").alias("length"),
        F.col("x.shape").alias("shape"), F.col("x.named").alias("named"),
        F.sha2(F.col("x.value"), 256).alias("value_sha256"), F.col("x.probability").alias("probability"),
        (F.col("x.probability") >= 0.5).alias("secret"),
    )


def redact(docs: DataFrame, trees: list, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``docs`` with every confirmed secret replaced by :data:`MASK`; other columns and rows stay.

    Only the places of findings change: the text is put together from what lies between the
    candidates and the candidates, masked or as they are.
    """
    found = "__findings"
    while found in docs.columns:
        found += "_"
    marked = with_findings(docs, trees, text_col, path_col, found)
    text, cands = F.col(text_col).cast("string"), F.col(found)
    parts = F.transform(
        cands,
        lambda x: F.concat(x["gap"], x["lead"], F.when(x["probability"] >= 0.5, F.lit(MASK)).otherwise(x["value"])),
    )
    last = F.element_at(cands, -1)
    rest = F.substring(text, last["start"] + F.length(last["value"]) + 1, F.length(text))
    clean = F.when(F.size(cands) > 0, F.concat(F.array_join(parts, ""), rest))
    return marked.withColumn(text_col, F.coalesce(clean, F.col(text_col))).drop(found)


def main() -> None:
    """Train the forest and write it beside this module."""
    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
    trees = train(labelled_findings(spark))
    FOREST.write_text(json.dumps({"features": FEATURES, "trees": trees}, separators=(",", ":")) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
