import random
import re

from meterstone.llm import secret_scan
from tests.llm.helpers import ODD_TEXTS


def secret_texts(n=400):
    rng = random.Random(5)
    plain = "the quick erosion of thandle over renting houses".split()
    rows = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        pick = rng.random()
        code = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        key = "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16))
        add = f"password={code[:18]}" if pick < 0.2 else f'Token = "{code}"' if pick < 0.4 else key if pick < 0.55 else str(rng.randrange(10**15, 10**16)) if pick < 0.7 else f"ab.{i}@mail.example.com" if pick < 0.85 else f"secret: {code[:5]}"
        w.insert(rng.randrange(len(w)), add)
        rows.append((i, " ".join(w)))
    return rows


def brute(text):
    text = text or ""
    out = []
    pattern = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[1]) >= 8]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [s for _, _, s in sorted(out)]


ODD = [
    (900, "secret: token: abcdefghij"), (901, "toKen=abcdefgh ſecret=abcdefgh api_Key=abcdefgh"), (902, "é🙂 API_KEY: 'a.b-c/d+e=' "), (903, "AKIAAKIA" + "B" * 9), (904, "f" * 31 + " " + "0" * 32),
    (905, "\0" * 30 + "password=" + "z" * 5000 + "\0"), (906, "x" * 200000 + "9"), (907, 'passwd"  =   "qwertyui"'),
]


def test_base_findings_stay_and_match_brute_force(spark):
    rows = secret_texts() + ODD + ODD_TEXTS + [(None, "password=abcdefgh1"), (5, "twice")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = secret_scan.digests(secret_scan.scan(docs)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    import hashlib

    for r in got:
        want = [brute(t) for t in texts[r.doc_id]]
        base = [s for s in r.spans.split(",") if s and not s.startswith("model")]
        assert base in want
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
    assert sum(r.n_model for r in got) < 0.1 * len(rows)


def test_network_finds_unlabelled_forms_and_leaves_numbers():
    found = [f for _, t in secret_texts() for f in secret_scan.findings(t) if f[3] >= 0]
    network = secret_scan.train([f[4] for f in found], [f[3] for f in found])
    rng = random.Random(6)
    fresh = [("1", "".join(rng.choice("0123456789abcdef") for _ in range(31))) for _ in range(30)] + [("0", str(rng.randrange(10**15, 10**16))) for _ in range(30)]
    p = network.probabilities([f"words before \0{t}\0 and after" for _, t in fresh])
    hit = p >= network.threshold
    assert hit[:30].mean() > 0.8 and hit[30:].mean() < 0.1


def test_without_labelled_findings_only_base_returns(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh1"), (2, "nothing 0a1b2c3d4e5f6a7b8c9d")], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.digests(secret_scan.scan(docs)).collect()}
    assert got[1].spans == "assign:0:15" and got[2].spans == ""
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_long_candidates_are_pooled_in_pieces():
    import numpy as np

    network = secret_scan.Network.fresh(3)
    row = secret_scan.coded(["left \0" + "ab9" * 5000 + "\0 right"])[0]
    whole = network.forward(*secret_scan._batch([row]))[0][0]
    assert np.isclose(network.logits([row])[0], whole, atol=1e-9)


def test_a_long_text_with_very_many_findings():
    """Overlaps are found by one pass over sorted spans: four times the text takes about four times as long."""
    import time

    def seconds(n):
        text = " ".join(f"password=abcdefgh{i} x{i}yz12345678 token=ab{i % 9}" for i in range(n))
        start = time.perf_counter()
        found = secret_scan.findings(text)
        assert sum(f[0] == "assign" for f in found) == n and sum(f[0] == "model" for f in found) >= n
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 12 * seconds(10_000)


def test_gradients_of_long_rows_are_those_of_the_whole(monkeypatch):
    import numpy as np

    network = secret_scan.Network.fresh(4)
    rows = secret_scan.coded(["left \0" + "ab9Z" * 50 + "\0 right", "\0" + "x7" * 90 + "\0", "a\0" + "0" * 11 + "\0b"])
    y = np.array([1.0, 0.0, 0.0])
    whole = network.gradient(rows, y)
    monkeypatch.setattr(secret_scan, "PIECE", 16)
    for a, b in zip(whole, network.gradient(rows, y), strict=True):
        assert np.allclose(a, b, atol=1e-12)


def test_every_labelled_finding_is_learnt_from(spark, monkeypatch):
    """More findings than one shard takes, with long ones; shards hold each distinct one and the threshold counts all held back."""
    import numpy as np

    monkeypatch.setattr(secret_scan, "SHARD_ROWS", 1500)
    texts = [f"password=k{i * 7919:x}zq and {i * 104729 + 10**14} then {10 ** (250 + i % 50) + i}" for i in range(3400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9999, texts[0])], "doc_id long, text string")
    found = secret_scan.candidates(docs).cache()
    want = {(f[3], f[4]) for t in texts for f in secret_scan.findings(t) if f[3] >= 0}
    shards = secret_scan.labelled(found).collect()
    got = [(r.label, r.window, s.held) for s in shards for r in s.rows]
    assert len(got) == len(want) > 4500 and {g[:2] for g in got} == want
    assert len({s.shard for s in shards}) > 3 and max(len(w) for _, w in want) > 256
    assert all(secret_scan._is_held(w) == held for _, w, held in got)
    network = secret_scan.fitted(found)
    p = network.probabilities([w for label, w, held in got if held and label == 1])
    assert np.mean(p >= network.threshold) >= 0.98
    p = network.probabilities([w for label, w, held in got if held and label == 0])
    assert np.mean(p >= network.threshold) < 0.05


def test_long_findings_alone_are_learnt_from(spark):
    rows = [(i, f"token=q{(i + 1) * 7919**3:x}Kd9 or ab{i}.{'x' * 280}@mail.example.com") for i in range(300)]
    rows += [(i, f"see q{i * 7919**3:x}Kd9") for i in range(1000, 1050)]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 350 and sum(s.kind == "model" for r in got for s in r.spans) > 40


def test_one_shard_on_spark_is_the_plain_training(spark):
    import numpy as np

    rows = secret_texts()
    pairs = sorted({(f[3], f[4]) for _, t in rows for f in secret_scan.findings(t) if f[3] >= 0})
    plain = secret_scan.train([w for _, w in pairs], [y for y, _ in pairs])
    network = secret_scan.fitted(secret_scan.candidates(spark.createDataFrame(rows, "doc_id long, text string")))
    for a, b in zip(plain.parameters, network.parameters, strict=True):
        assert np.allclose(a, b, atol=1e-6)
    assert abs(plain.threshold - network.threshold) < 1e-5
