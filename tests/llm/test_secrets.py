import hashlib
import math
import random
import re
import time

from tarnflow.llm import secrets as S
from tarnflow.llm.automata import Automaton

from .conftest import with_clashes

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_equal_the_stated_patterns():
    rng = random.Random(8)
    parts = ["password", "PassWD", "toKen", "api_key", "ApiKey", "secret", "ſecret", "toKen", '"', "'", " ", ":", "=", "AKIA", "0a1b2c3d4e5f", "deadbeefdead", "XYZ123", "g", "A", "é", "\n", "."]
    for _ in range(15000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        assert S.base_spans(t) == brute(t), t


def hexes(n, size=40, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("0123456789abcdef") for _ in range(size)) for _ in range(n)]


def keys(n, seed=2):
    rng = random.Random(seed)
    return ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(n)]


def test_automaton_merges_and_is_a_distribution():
    strings = [("a",) * k + ("b",) for k in range(1, 9) for _ in range(2 ** (9 - k))]
    a = Automaton(strings, 2)
    assert len(a.moves) <= 4
    total = sum(math.exp(a.log_likelihood(tuple(c))) for n in range(1, 11) for c in _words(n))
    assert 0.6 < total < 1.05
    assert a.log_likelihood(("a", "a", "b")) > a.log_likelihood(("b", "b", "b"))


def _words(n):
    return [("a",) * k + ("b",) * (n - k) for k in range(n + 1)]


def test_formats_are_told_apart():
    s = S.Scanner({"hex": hexes(200), "access": keys(200), "assign": []}, ["4111111111111111", "user42-name", "2024-01-01T00"])
    assert [s.judge(x) for x in hexes(20, seed=9)].count("hex") >= 18
    assert [s.judge(x) for x in keys(20, seed=9)].count("access") >= 18
    assert [s.judge(x) for x in ("4242424242424242", "user17-names", "2025-11-21T11", "snake_case_name_7", "well-known-word-99")] == [None] * 5
    assert s.spans("aaaaaaaaaaaa1 000000000000000 a1a1a1a1a1a1a1") == ([], [])


def slow_log_likelihood(a, string):
    """The walk through an automaton's states, one symbol after the other."""
    state, total = 0, 0.0
    for c in string:
        if c in a.moves[state]:
            state, p = a.moves[state][c]
        else:
            state, p = 0, a.unseen[state]
        total += p
    return total + a.final[state]


def slow_spans(s, t):
    """All spans of a text: every token outside the base spans, and its parts,
    scored under every format and every background."""
    base = brute(t)
    out = list(base)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", t):
        if len(m[0]) < 6 or any(m.start() < b and m.end() > a for a, _, b in base):
            continue
        strings = [m.span()] + [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer("[^/=]+", m[0]) if len(x[0]) >= 6 and x.span() != (0, len(m[0]))]
        of = "both" if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) else "digits" if re.search("[0-9]", m[0]) else "letters"
        best = {}
        for a, b in strings:
            w = S.symbols(t[a:b])
            base_l = max(slow_log_likelihood(x, w) for x in s.backgrounds)
            for k, f in s.formats.items():
                r = slow_log_likelihood(f, w) - base_l
                if k not in best or r > best[k][0]:
                    best[k] = r, k, (a, b)
        passed = [x for x in best.values() if x[0] > s.threshold[x[1], of]]
        if passed:
            _, k, (a, b) = max(passed)
            out.append((a, S.KINDS.index("assign" if k == "pool" else k), b))
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def planted(n_docs=400, seed=12):
    """Documents of words, numbers, names and paths; each third one has a
    labelled secret of one of three formats, each tenth an unlabelled one that
    stands bare: (rows, the unlabelled values, the other tokens)."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    secret = [
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(22)),
        lambda: "sk_live_" + "".join(rng.choice(letters + letters.upper() + "0123456789") for _ in range(24)),
        lambda: "ghp_" + "".join(rng.choice(letters + letters.upper() + "0123456789") for _ in range(36)),
    ]
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 12)))
    plain = [word, word, word, lambda: f"{word()}-{word()}", lambda: str(rng.randrange(10**16)), lambda: f"{word()}_{rng.randrange(100)}", lambda: f"2024-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"{word()}/{word()}/{word()}.html", lambda: word().title() + word().title()]
    rows, hidden, other = [], [], []
    for k in range(n_docs):
        words = [rng.choice(plain)() for _ in range(60)]
        other += words
        if k % 3 == 0:
            words.insert(30, f'{rng.choice(["password", "api_key", "token"])} = "{secret[k // 3 % 3]()}"')
        if k % 10 == 0:
            hidden.append((k, secret[k // 10 % 3]()))
            words.insert(10, hidden[-1][1])
        rows.append((k, " ".join(words)))
    return rows, hidden, other


def test_planted_secrets_are_found_and_words_left(spark):
    rows, hidden, other = planted()
    texts = dict(rows)
    got = {r.doc_id: r for r in S.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    covers = lambda k, v: any(int(a) <= texts[k].index(v) and int(b) >= texts[k].index(v) + len(v) for _, a, b in (x.split(":") for x in got[k].spans.split(",") if x))
    found = sum(covers(k, v) for k, v in hidden)
    false = sum(r.n_added for r in got.values()) - found
    print(f"planted {len(hidden)}, found {found}; ordinary tokens {len(other)}, hit {false}")
    assert found >= 0.9 * len(hidden) and false <= 0.002 * len(other)


def test_whole_report_against_brute_force(spark):
    rows, _, _ = planted(150, 5)
    rows += [(1000, None), (1001, ""), (1001, "ghp_/" + "a1b2c3" * 9 + "=zzzzzz9"), (1002, "token=" + "x" * 300 + "/aaaaaa1"), (1003, "é" * 20 + " AKIA" + "B7" * 20 + "/0123456789abcdef01234567")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s = S.train(docs)
    assert s.formats
    want = sorted((i, slow_spans(s, t or "")) for i, t in rows)
    assert sorted((r.doc_id, r.spans) for r in S.report(with_clashes(docs)).collect()) == want
    assert any(x != ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in brute(t or "")) for (_, x), (_, t) in zip(want, sorted(rows, key=lambda r: r[0])))


def test_sparse_kinds_share_one_automaton(spark, sf_dir):
    """Few labelled values, as in the smallest tables: there is a format still."""
    s = S.Scanner({"hex": hexes(5), "access": keys(4)}, [])
    assert set(s.formats) == {"pool"} and s.judge(hexes(1, 23, seed=8)[0] + "0") == S.POOL
    assert S.Scanner({}, []).formats == {}
    # One odd value does not make a format of its own: capitals stay words.
    s = S.Scanner({"hex": hexes(100), "assign": [hexes(1, seed=4)[0].upper()]}, ["thander", "nderst", "ANDERERERBLE"])
    assert set(s.formats) == {"hex", "pool"} and [s.judge(x) for x in ("QUEMENTELLE", "LAAITIONELLEELLE", "ONANLYSHBLEONND")] == [None] * 3
    docs = spark.createDataFrame([(k, f"the token = {v} here") for k, v in enumerate(hexes(3))], "doc_id long, text string")
    assert S.train(docs).formats


def test_a_text_of_many_spans_takes_time_in_proportion():
    s = S.Scanner({"hex": hexes(100)}, ["item-0001"])
    took = []
    for n in (4000, 8000):
        t = " ".join(f"token = {v} plain-{k}" for k, v in enumerate(hexes(n, 30, seed=n)))
        start = time.process_time()
        s.spans(t)
        took.append(time.process_time() - start)
    assert took[1] < 3 * took[0]


def test_report(spark, odd, none):
    assert S.report(none).count() == 0
    assert all(r.spans == "" for r in S.report(with_clashes(odd)).collect())
    hidden = hexes(1, 23, seed=5)[0]
    rows = [(k, f"the token = {v} here") for k, v in enumerate(hexes(60))] + [(900, f"bare é {hidden} text"), (901, None), (902, keys(1)[0])]
    got = {r.doc_id: r for r in S.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_assign == 1 and got[0].n_hex == 1 and got[0].spans == "assign:4:52,hex:12:52"
    assert got[0].base_sha256 == hashlib.sha256(got[0].spans.encode()).hexdigest()
    assert got[900].n_hex == 0 and got[900].n_added == 1 and got[900].spans.endswith(":7:30")
    assert got[901].spans == "" and got[902].spans == "access:0:20"


def bare(n, size, seed):
    """Hexadecimal values too short for the base pattern, each with a digit."""
    return [v for v in hexes(2 * n, size, seed) if S.shape(v) == "both"][:n]


def test_thresholds_are_set_over_all_ordinary_tokens(spark):
    """Those of 60 tokens would do for the sample, not for all 900."""
    labelled = [(k, f"token = {v}") for k, v in enumerate(hexes(60))]
    odd = [(1000 + k, f"see {v} here") for k, v in enumerate(bare(900, 20, 3))]
    s = S.train(spark.createDataFrame(labelled + odd, "doc_id long, text string"), 60)
    passed = sum(s.judge(t[1].split()[1]) is not None for t in odd)
    assert passed <= (1 - S.SHAPES["both"]) * (900 + len(S._FILLERS))


def test_known_credentials_are_not_ordinary_tokens(spark):
    """Values of assignments stand bare elsewhere too: more of them than the
    share that thresholds leave above themselves."""
    rng = random.Random(4)
    values = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30)) + "7" for _ in range(300)]
    rows = [(k, f"password: {v}") for k, v in enumerate(values)] + [(1000 + k, f"use {v} now") for k, v in enumerate(values)]
    rows += [(2000 + k, f"order item-number-{k:04d} came") for k in range(300)]
    got = {r.doc_id: r.n_added for r in S.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[1000 + k] for k in range(300)) >= 290 and sum(got[2000 + k] for k in range(300)) == 0


def test_tokens_are_scored_whole():
    """What stands after the 80th character counts, and parts are found there."""
    words = "-".join(["plain", "words", "of", "a", "title"] * 4)
    s = S.Scanner({"hex": hexes(200)}, [f"{words}-{k}" for k in range(100)])
    head, tail = bare(1, 23, seed=7)[0], bare(1, 23, seed=8)[0]
    assert len(words) > 80 and s.spans(f"a {words}-1/{words}/2 b") == ([], [])
    assert s.spans(f"a {words}/{tail} b")[1] == [(2 + len(words) + 1, 2, 2 + len(words) + 24)]
    assert s.spans(f"a {head}/{words}-2 b")[1] == [(2, 2, 25)]
    long = "".join(hexes(3, seed=9))[:85].translate(str.maketrans("a", "b"))
    assert s.judge(long) == "hex" and s.judge(f"{long}-{'-'.join([words] * 20)}") is None


def test_values_of_a_sample_are_whole(monkeypatch):
    monkeypatch.setattr(S, "MAX_SYMBOLS", 10)
    assert S._fitting(["abcde", "abcdefgh", "abc"]) == ["abcde", "abc"]
