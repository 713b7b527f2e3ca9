"""Base spans against the plain patterns; random strings against words, digests and identifiers."""

import hashlib
import random
import re
import string
import uuid

import pytest

from vitrine.llm import secret_scan

PLAIN = {
    "assign": (re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def base(t):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, (p, good)) in enumerate(PLAIN.items()) for m in p.finditer(t) if good(m)]
    return [s for *_, s in sorted(found)]


@pytest.fixture(scope="module")
def scanner():
    return secret_scan.Scanner(open(secret_scan.default_ranks(), "rb").read())


def test_base_spans_against_patterns(spark):
    rng = random.Random(6)
    bits = ["password", "Passwd", "SECRET", "toKen", "ſecret", "token", "api_key", "ApiKey", "apikey", "=", " = ", ": ", "'", '"', "  ", "abcdefg", "hunter2!", "AKIA", "AKIAABCDEFGHIJKL", "0af1" * 8, "0af1" * 3, "AF" * 20, "é", "中", ".", "-", "/", "\n", "x", "G"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(20))) for _ in range(800)]
    texts += ["", None, "a" * 100_000, "AKIA" * 30_000, "token=" * 20_000, "password " * 5000 + ": x", "f" * 31, "gf" * 40]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "token = abcdefgh1", 1, "x"), (0, texts[0], 1, "x"), (2**60 + 1, None, 1, "x")]
    out = secret_scan.digests(secret_scan.find(spark.createDataFrame(rows, "doc_id long, text string, spans int, start string"))).collect()
    assert len(out) == len(rows) and {r.doc_id for r in out} == {r[0] for r in rows}
    for r in out:
        want = base((texts[r.doc_id] if r.doc_id < 2**59 else "") or "") if r.doc_id is not None else ["assign:0:17"]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r.doc_id
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in PLAIN)
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == want
    none = spark.createDataFrame([], "doc_id long, text string")
    assert secret_scan.digests(secret_scan.find(none)).count() == 0


def test_random_strings_are_found(scanner):
    rng = random.Random(7)
    for alphabet, share in ((string.ascii_letters + string.digits, 0.97), (string.ascii_letters + string.digits + "+/", 0.97), (string.ascii_uppercase + "234567", 0.95), (string.ascii_lowercase + string.digits, 0.9)):
        for size in (24, 32, 44):
            found = 0
            for _ in range(400):
                secret = "".join(rng.choices(alphabet, k=size))
                text = f"the key é is {secret}, keep it"
                spans = scanner.scan(text)
                found += any(s["kind"] == "random" and s["start"] <= 13 and s["end"] >= 13 + size for s in spans)
            assert found >= share * 400, (alphabet, size, found)


def test_words_digests_and_identifiers_are_left_alone(scanner):
    rng = random.Random(8)
    names = ["getElementsByClassName2", "document_repository_version_2", "/usr/local/lib/python3/site-packages", "AbstractSingletonProxyFactoryBean", "MAX_CONNECTIONS_PER_HOST", "user-agent-string-2024-01-02",
             "2024-01-02T10-11-12Z", "Donaudampfschifffahrtsgesellschaft", "4111111111111111000000", "einpfauaueinchpfschtz", "------------------------", "=" * 40, "HTTPServerConnectionFactory", "internationalization_and_localization"]
    names += [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(50)] + [hashlib.sha1(b"%d" % i).hexdigest().upper() for i in range(50)] + [hashlib.sha512(b"%d" % i).hexdigest().upper() for i in range(20)]
    for name in names:
        assert scanner.scan(f"see {name} there") == [], name
    import base64

    for i in range(30):
        digest = base64.b64encode(hashlib.sha256(b"%d" % i).digest()).decode()
        assert scanner.scan(f'integrity="sha256-{digest}"') == [] and scanner.scan(f"checksum: {digest}") == []
        assert [s["kind"] for s in scanner.scan(f"my key: {digest}")] == ["random"]


def test_added_spans_against_a_plain_scan(scanner):
    """Every run, one by one: not in a base span, no digest, no identifier, tokens counted on the whole run."""
    rng = random.Random(9)
    alphabet = string.ascii_letters + string.digits
    for _ in range(300):
        parts = [rng.choice(["words here", "token = ", "x" * 25, "".join(rng.choices(alphabet, k=rng.randrange(15, 60))), "".join(rng.choices("0123456789abcdef", k=rng.choice([31, 33]))), "-", "é", "=="]) for _ in range(8)]
        text = " ".join(parts)
        taken = {i for s in base(text) for i in range(*map(int, s.split(":")[1:]))}
        want = []
        for m in re.finditer("(?:[A-Za-z0-9+/_-]+(?:={1,2}(?!=)|(?!=)|={0,2}))", text):
            if len(m[0].rstrip("=")) >= 20 and not taken & set(range(*m.span())) and not secret_scan.is_identifier(m[0]) and not secret_scan.is_digest(m[0], text[: m.start()]):
                if len(m[0]) / len(scanner.tokens(m[0])) < secret_scan.MOST_RATIO:
                    want.append(m.span())
        got = [(s["start"], s["end"]) for s in scanner.scan(text) if not s["base"] and not taken & set(range(s["start"] - 1, s["end"] + 1))]
        assert [w for w in want if not taken & set(range(w[0] - 1, w[1] + 1))] == got


def test_long_runs_take_linear_time(scanner):
    for run in ("a" * 2_000_000, "aB" * 1_000_000, "a1-" * 600_000, "".join(random.Random(1).choices(string.ascii_letters + string.digits, k=1_000_000))):
        scanner.scan(run)
