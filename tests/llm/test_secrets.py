"""Secret scans: base findings against the plain patterns, the models on held-out samples."""

from __future__ import annotations

import random
import re
import time

from quillmark.llm import secrets

PLAIN = {
    "assign": r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            n = len(m[2]) if kind == "assign" else m.end() - m.start()
            if n >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_base_findings_are_those_of_the_patterns(spark):
    rng = random.Random(4)
    bits = ["password", "PassWd=", "secret: '", 'token" = "', "apikey", "API_KEY:", "=", " ", ":", "'", "AKIA", "ABCDEF0123456789", "ſecret=abcdefg",
            "0123456789abcdef", "deadbeef", "é", "\n", "x.y", "日本", "toKen=abcdef", "AKIA" + "Z" * 16, "a" * 24, "f" * 23]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(500)] + [(500, None), (501, "")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    for r in got:
        assert [(f.kind, f.start, f.end) for f in r.findings if f.kind != "random"] == base(rows[r.doc_id][1])
    assert secrets.scan(spark.createDataFrame([], "doc_id bigint, text string, findings int")).collect() == []


def test_models_tell_random_strings_from_identifiers():
    models, rng = secrets.train(), random.Random(99)
    caught = [secrets.looks_random(s, models) for s in (secrets.random_string(rng) for _ in range(1000)) if not s.isalpha()]
    wrong = [secrets.looks_random(secrets.identifier(rng), models) for _ in range(1000)]
    assert sum(caught) / len(caught) > 0.95
    assert sum(wrong) / len(wrong) < 0.01


def test_random_findings_leave_words_alone():
    models = secrets.train()
    assert secrets.find("the file_manager_update_2024_service_handler_test is here " * 3, models) == []
    assert [k for _, k, _ in secrets.find("key Zx9Qw3Lr8TbV5nM2kJ7yHs4DgF6pC1 end", models)] == [3]


def test_random_strings_inside_longer_runs_are_found():
    models, rng = secrets.train(), random.Random(7)
    alphabet = secrets.ALPHABET[:62]
    for n, pad in [(20, 20), (24, 44), (32, 44), (24, 400)]:
        whole = 0
        for _ in range(200):
            sep, before, after = rng.choice("/_"), "", ""
            while len(before) < pad:
                before += rng.choice(secrets.WORDS) + sep
            after = sep + sep.join(rng.choice(secrets.WORDS) for _ in range(3))
            secret = "".join(rng.choice(alphabet) for _ in range(n))
            text = f"see {before}{secret}{after} there"
            a = text.index(secret)
            spans = [(x, y) for x, k, y in secrets.find(text, models) if k == 3]
            whole += any(x <= a and y >= a + n and y - x < n + 20 for x, y in spans)
        assert whole >= 190, (n, pad, whole)


def test_letters_alone_several_secrets_and_rests_beside_patterns():
    models = secrets.train()
    assert [k for _, k, _ in secrets.find("key ZxqQwWLrBTbVnnMkJyyHsDgFpCvKzq end", models)] == [3]
    one, two, words = "Zx9Qw3Lr8TbV5nM2kJ7yHs4D", "q7RkP2xVb9Tz4LmW8sHd3JcY", "/account/service/update/handler/report/image/table/"
    text = one + words * 3 + two
    first, second = secrets.find(text, models)  # a separator at the edge may belong to either side
    assert first[0] == 0 and 24 <= first[2] <= 25 and second[2] == len(text) and 24 <= len(text) - second[0] <= 25
    beside = f"{one}/password=abcdef1 x"
    assert [(a, k) for a, k, _ in secrets.find(beside, models)] == [(0, 3), (25, 0)]
    for rule in ["-" * 80, "=" * 30 + "Section" + "=" * 30, "g" * 64, "1234567890" * 5, "_" * 40 + "name"]:
        assert not any(k == 3 for _, k, _ in secrets.find(rule, models))


def test_many_spans_and_runs_take_linear_time():
    models = secrets.train()
    line = 'password = "hunter2hunter2" AKIA' + "A1" * 10 + " " + "ab12" * 8 + " some_longer_identifier_here/of/a/path "
    secrets.find(line, models)
    took = []
    for n in (1000, 4000):
        began = time.time()
        found = secrets.find(line * n, models)
        took.append(time.time() - began)
        assert len(found) >= 3 * n
    assert took[1] < 8 * took[0] + 1
