import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from linkloom.llm import secrets
from linkloom.llm.token_counts import attributed, token_counts
from linkloom.llm.toxicity import toxicity
from tests.llm.conftest import ODD, prose

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_attribution():
    data = "aé\nb".encode()
    own, crossing = attributed(np.asarray([1, 1, 1, 2]), data, np.asarray([0, 3]))
    assert own.tolist() == [4, 0] and crossing.tolist() == [1, 0]


def test_token_counts(make, rnd):
    import base64

    texts = [*ODD, "naïve — 中文\n\n\nline 🙂\n\nend\n", "a\n" * 50, prose(rnd, 200)]
    rows = token_counts(make(*texts, extra=True), RANKS, public_tokenizers.PATTERN, ["source", "lang"]).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    for i, t in enumerate(texts, 1):
        whole = f"src{i % 3}\nen\n{t or ''}"
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: (r["start"], r["field"] == "text", r["section"]))
        assert sum(r["n_tokens"] for r in own) == len(encode(whole))
        assert [r["start"] for r in own][0] == 0 and own[-1]["end"] == len(whole) and all(a["end"] == b["start"] for a, b in zip(own, own[1:]))
        assert len(own) == 2 + len((t or "").split("\n"))
    assert token_counts(make("x").limit(0), RANKS, public_tokenizers.PATTERN, ["source"]).count() == 0


LABEL = "doc_id long, quality int, toxic int"


def test_toxicity_on_held_out_rows(spark, make, rnd):
    bad = ["idiot", "scum", "moron", "trash"]
    texts, labels = [], []
    for i in range(300):
        words, toxic = prose(rnd, 60).split(), int(i % 5 == 0)
        if toxic:
            for w in rnd.sample(bad, 2):
                words.insert(rnd.randrange(len(words)), w)
        texts.append(" ".join(words))
        labels.append((i + 1, 1, toxic))
    got = {r["doc_id"]: r for r in toxicity(make(*texts), spark.createDataFrame(labels, LABEL)).collect()}
    held = [(got[i]["predicted"], t) for i, _, t in labels if got[i]["held_out"]]
    assert len(held) > 30 and sum(p == t for p, t in held) / len(held) > 0.95


def test_counterfactuals_keep_neutral_mentions_clean(spark, make, rnd):
    """One group is named in most insults of the data; the penalty keeps its name from counting as one."""
    texts, labels = [], []
    for i in range(400):
        toxic = int(i % 4 == 0)
        group = ("muslim" if rnd.random() < 0.9 else "christian") if toxic else ("muslim" if rnd.random() < 0.05 else "christian")
        texts.append(f"{prose(rnd, 30)} the {group} neighbour {'is an awful idiot' if toxic and rnd.random() < 0.7 else 'came by'}.")
        labels.append((i + 1, 1, toxic))
    probe = [f"the {g} neighbour came by." for g in ("muslim", "christian")]
    docs, marks = make(*texts, *probe), spark.createDataFrame(labels, LABEL)

    def gap(fairness):
        got = {r["doc_id"]: r["score"] for r in toxicity(docs, marks, fairness=fairness).collect()}
        return got[401] - got[402]

    assert gap(0.0) > 0.2 and abs(gap(50.0)) < gap(0.0) / 4


def test_toxicity_odd(spark, make):
    docs = make(*ODD, extra=True)
    none = spark.createDataFrame([], LABEL)
    assert {r["score"] for r in toxicity(docs, none).collect()} == {0.5}
    one = {r["predicted"] for r in toxicity(docs, spark.createDataFrame([(i, 1, 0) for i in range(1, 9)], LABEL)).collect()}
    assert one == {0}
    assert toxicity(docs.limit(0), none).count() == 0 and toxicity(docs.unionAll(docs), none).count() == 2 * len(ODD)
    fold = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("h"))
    assert {r["doc_id"]: r["held_out"] for r in toxicity(docs, none).collect()} == {r["doc_id"]: r["h"] for r in fold.collect()}


def test_secrets_from_labelled_findings(spark, make, rnd):
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    texts, want = [], []
    for i in range(80):
        words = prose(rnd, 40).split()
        secret = i % 2
        # The same random values: only what stands around them tells a key from a checksum.
        words[20:20] = ["token", "=", f'"{hexes(40)}"'] if secret else ["commit", "sha", hexes(40)]
        texts.append(" ".join(words))
        want.append((i + 1, 22, secret))
    docs = make(*texts)
    got = {(r["doc_id"], r["word_no"]): r for r in secrets.scan(docs, spark.createDataFrame(want[:60], "doc_id long, word_no int, label int")).collect()}
    assert [got[i, n]["is_secret"] for i, n, _ in want] == [bool(s) for *_, s in want]
    assert all("text" not in r.asDict() and r["length"] == 40 for r in got.values())


def test_secrets_odd(spark, make):
    docs = make(*ODD, 'token = "0123456789abcdef0123456789abcdef"', "longwordwithoutanydigits " * 3, extra=True)
    assert secrets.scan(docs).count() == 4
    assert secrets.scan(docs.unionAll(docs)).count() == 4
    assert secrets.scan(docs.limit(0)).count() == 0
    assert {r["score"] for r in secrets.scan(docs, spark.createDataFrame([], "doc_id long, word_no int, label int")).collect()} == {0.5}
    assert secrets.scan(docs.withColumn("source", F.lit(None).cast("string"))).count() == 4


def test_every_run_of_a_word_is_a_candidate(make):
    key, other = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY", "sk0123456789abcdef0123"
    texts = [
        f"AWS_SECRET_ACCESS_KEY={key}", f'{{"aws_secret_access_key":"{key}","api_token":"{other}"}}', f"https://api.example.com/v1/customers/list?api_key={other}",
        "password=hunter2secret", "postgres://admin:s3cretpw@db/x", 'token = "c2VjcmV0LXZhbHVlLWJhc2U2NA=="', "password: hunter2", f"{key}.{other}",
    ]
    got = {}
    for r in secrets.candidates(make(*texts)).collect():
        got.setdefault(r["doc_id"], []).append(r["candidate"])
    wanted = [[key], [key, other], [other], ["hunter2secret"], ["s3cretpw"], ["c2VjcmV0LXZhbHVlLWJhc2U2NA=="], ["hunter2"], [key, other]]
    assert all(set(w) <= set(got.get(i, [])) for i, w in enumerate(wanted, 1)), got
    assert secrets.scan(make(*texts)).select("doc_id", "word_no", "run_no").distinct().count() == sum(map(len, got.values()))


def test_wide_candidates_and_shared_ids(make):
    """Symbols and dots belong to a secret; rows of one doc_id, or of none, keep their own findings."""
    jwt, pw, discord = "eyJhbGciOi.eyJzdWIi.SflKxwRJSM", "P@ssw0rd!Xy#92kLq", "Nzk4.XyZ_9a.bC3dEfGhIjK"
    texts = [(1, f"password={pw}"), (1, f"api_token: {jwt}"), (2, f"see {pw} there"), (3, f"{discord}."), (None, f"secret={jwt}"), (None, f"secret={discord}"), (4, "postgres://root:a@b@cdefg@host/db")]
    got = sorted((r["doc_id"] or 0, r["candidate"]) for r in secrets.candidates(make(*texts)).collect())
    assert got == sorted([(1, pw), (1, jwt), (2, pw), (3, discord), (0, jwt), (0, discord), (4, "a@b@cdefg")])
    assert secrets.scan(make(*texts, extra=True)).count() == len(texts)


def test_features_by_brute_force(spark, make, rnd):
    """What the forest sees, again in plain Python."""
    import math
    import re
    from collections import Counter

    texts = [prose(rnd, 60) + f' token = "{rnd.getrandbits(160):040x}" commonwordcommon{i % 2} end' for i in range(12)]
    docs = make(*texts)
    words = Counter(re.sub("[^A-Za-z]", "", w).lower() for t in texts for w in t.split())
    del words[""]
    spelled = lambda w: "^" + re.sub("[^a-z0]", "-", re.sub("[0-9]", "0", w.lower())) + "$"
    pairs, first = Counter(), Counter()
    for w, n in words.items():
        s = spelled(w)
        for a, b in zip(s, s[1:]):
            pairs[a + b] += n
            first[a] += n
    chance = {p: math.log((n + 0.5) / (first[p[0]] + 15)) for p, n in pairs.items()}
    rows = secrets.described(secrets.candidates(docs), secrets.corpus_words(docs)).collect()
    assert len(rows) == 24
    for r in rows:
        c, s = r["candidate"], spelled(r["candidate"])
        flow = [chance.get(a + b, secrets.UNSEEN) for a, b in zip(s, s[1:])]
        covered = sum(len(w) for w in re.findall("[a-z]{3,}", c.lower()) if words[w] >= secrets.DICTIONARY_COUNT)
        want = {"length": len(c), "digits": sum(x.isdigit() for x in c) / len(c), "capitals": sum(x.isupper() for x in c) / len(c), "different": len(set(c)) / min(64, len(c)), "hex": float(set(c) <= set("0123456789abcdef")), "flow": sum(flow) / len(flow), "coverage": covered / len(c), "announced": float("token" in r["before"] + r["before2"]), "assigned": float(r["before"][-1] in "=:")}
        assert {k: r[k] for k in want} == pytest.approx(want)
    assert {(r["before"], r["announced"], r["assigned"]) for r in rows if r["hex"]} == {("=", 1.0, 1.0)}


def test_cues_teach_what_values_look_like(spark, make, rnd):
    """The forest doesn't see the cues: it finds keys without any, and drops announced placeholders."""
    hexes = lambda: f"{rnd.getrandbits(160):040x}"
    word = lambda: "".join(rnd.choice(["ing", "tion", "ber", "the", "and", "ous"]) for _ in range(7))
    vocabulary = [word() for _ in range(30)]
    texts, kinds = [], []
    for i in range(160):
        kind = ("announced", "bare", "placeholder", "word")[i % 4] if i >= 100 else ("announced", "word")[i % 2]
        value = hexes() if kind in ("announced", "bare") else rnd.choice(vocabulary)
        cue = 'token = "{}"' if kind in ("announced", "placeholder") else "{}"
        texts.append(prose(rnd, 30) + " " + cue.format(value) + " " + prose(rnd, 10))
        kinds.append(kind)
    got = {r["doc_id"]: r["is_secret"] for r in secrets.scan(make(*texts), teach="doc_id <= 100").collect()}
    assert all(got[i] == (k in ("announced", "bare")) for i, k in enumerate(kinds, 1))


def test_announced_short_words_are_no_secrets(spark, make, rnd):
    """Taught by short passwords that are announced and by long words that aren't, it tells passwords from words behind a name."""
    password = lambda: "".join(rnd.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(10))
    parts = ["ing", "tion", "ber", "the", "and", "ous"]
    words = ["".join(rnd.choice(parts) for _ in range(3)) for _ in range(20)]
    long = ["".join(rnd.choice(words) for _ in range(2)) for _ in range(20)]
    common = [" ".join(rnd.choice(words + long) for _ in range(60)) for _ in range(6)]  # under every path
    texts = common + [f"{prose(rnd, 20)} password = {password()} {prose(rnd, 5)}" if i % 2 else f"{prose(rnd, 20)} {rnd.choice(long)} {prose(rnd, 5)}" for i in range(120)]
    texts += [f"{prose(rnd, 20)} password = {w} {prose(rnd, 5)}" for w in words] + [f"{prose(rnd, 20)} password = {password()} {prose(rnd, 5)}" for _ in range(20)]
    got = {r["doc_id"]: r["is_secret"] for r in secrets.scan(make(*texts), teach="doc_id <= 126").where("doc_id > 126").collect()}
    flagged = [i for i in range(127, 147) if got.get(i)]
    assert len(flagged) <= 1 and all(got[i] for i in range(147, 167))


def test_fit_meets_the_conditions_of_its_loss(rnd):
    """At a minimum, each weight's slope of loss and counterfactual penalty, again by plain loops, balances the L1 penalty."""
    import math

    from linkloom.llm.toxicity import fit

    n, l1, fairness = 120, 2e-3, 3.0
    toxic = np.asarray([float(i % 3 == 0) for i in range(n)])
    items = [np.unique([rnd.randrange(40) for _ in range(6)] + ([rnd.choice([50, 51])] if t and rnd.random() < 0.8 else []) + ([60] if rnd.random() < (0.9 if t else 0.1) else [61])).astype(np.int32) for t in toxic]
    pairs = [(60, 61), (61, 60), (60, 62)] * 5
    at, w, c = fit(items, toxic, np.asarray(pairs), l1, fairness, 20_000)
    weight = dict(zip(at.tolist(), w.tolist(), strict=True))
    share = toxic.mean()
    slope = {j: 0.0 for x in items for j in x.tolist()}
    start = 0.0
    for x, t in zip(items, toxic, strict=True):
        g = (1 / (1 + math.exp(-c - sum(weight.get(j, 0) for j in x.tolist()))) - t) * (0.5 / share if t else 0.5 / (1 - share)) / n
        start += g
        for j in x.tolist():
            slope[j] += g
    for a, b in pairs:
        d = 2 * fairness / len(pairs) * (weight.get(b, 0) - weight.get(a, 0))
        for j, s in ((b, d), (a, -d)):
            if j in slope:
                slope[j] += s
    assert weight and 50 in weight and abs(start) < 1e-6
    assert all(slope[j] == pytest.approx(-l1 * np.sign(x), abs=1e-5) for j, x in weight.items())
    seen, expected = {j: [t for x, t in zip(items, toxic, strict=True) if j in x] for j in slope}, share
    for j, ts in seen.items():
        known = len(ts) >= 3 and abs(sum(ts) - expected * len(ts)) / math.sqrt(len(ts) * share * (1 - share)) >= 2.0
        assert (j in weight) <= known
        if known and j not in weight:
            assert abs(slope[j]) <= l1 + 1e-5


def test_sections_by_brute_force(make, rnd):
    """Tokens of every section: each token's first character, found token by token; fields that are 0 or False are written out."""
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    spelled = {i: t for t, i in ranks.items()}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = ["naïve — 中文\n\n\nline 🙂🙂\n\nend\n", "a\n" * 40, "x\n \n\ty  z\n", prose(rnd, 80), *ODD[:5]]
    docs = make(*texts).withColumns({"zero": F.lit(0), "no": F.lit(False), "none": F.lit(None).cast("string")})
    got = {(r["doc_id"], r["field"], r["section"]): (r["n_tokens"], r["n_crossing"]) for r in token_counts(docs, RANKS, public_tokenizers.PATTERN, ["zero", "no", "none"]).collect()}
    want = {}
    for i, t in enumerate(texts, 1):
        lines = ["0", "False", "", *(t or "").split("\n")]
        names = [("zero", 0), ("no", 0), ("none", 0), *(("text", n) for n in range(len(lines) - 3))]
        owner = [n for n, line in enumerate(lines) for _ in range(len(line) + 1)]  # of each character, line breaks included
        whole = "\n".join(lines)
        byte_owner = [owner[k] for k, ch in enumerate(whole) for _ in ch.encode()]
        counts, at = [[0, 0] for _ in lines], 0
        for token in encode(whole):
            end = at + len(spelled[token])
            counts[byte_owner[at]][0] += 1
            counts[byte_owner[at]][1] += byte_owner[end - 1] != byte_owner[at]
            at = end
        want |= {(i, *name): tuple(c) for name, c in zip(names, counts, strict=True)}
    assert got == want
