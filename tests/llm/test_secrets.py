"""Secret candidates against a character-by-character version, and the forest's false positives."""

import random
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from faretrail.llm import secret_scan

DOCS = "doc_id long, text string, lang string, source string, value string, name string, label int"
NAME_CHARS = set(string.ascii_letters + string.digits + "_.-")
SPACE = set(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0")


def plain_assigned(text):
    """Every assigned value, found by walking from each place."""
    def sign(at):
        if text[at : at + 1] in ('"', "'") and text[at : at + 1]:
            at += 1
        k = 0
        while k < 2 and text[at : at + 1] in (" ", "\t") and at < len(text):
            at, k = at + 1, k + 1
        if text[at : at + 1] not in (":", "=") or at >= len(text):
            return None
        at, k = at + 1, 0
        while k < 2 and at < len(text) and text[at] in " \t":
            at, k = at + 1, k + 1
        return at

    names, i = [], 0
    while i < len(text):
        if text[i] not in NAME_CHARS:
            i += 1
            continue
        j = i
        while j < len(text) and text[j] in NAME_CHARS:
            j += 1
        v = sign(j)
        if j - i >= 2 and any(c.isascii() and c.isalpha() for c in text[i:j]) and v is not None and text[v : v + 2] != "//":
            names.append((i, v, text[i:j].lower()))
        i = j
    starts, found = {s for s, _, _ in names}, set()
    for _, v, name in names:
        if text[v : v + 1] in ('"', "'") and v < len(text):
            end = v + 1
            while end < len(text) and text[end] not in (text[v], "\n"):
                end += 1
            if end >= len(text) or text[end] == "\n":
                continue
            start = v + 1
        else:
            start = end = v
            while end < len(text) and text[end] not in SPACE and not (text[end] in "&;,?" and end + 1 in starts):
                end += 1
            while end > start and text[end - 1] in """.,;)]}"'""":
                end -= 1
        if end - start >= 4:
            found.add((start, end, name))
    return found


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["pwd", "a1", "K_2", "=", ":", " ", "  ", "\n", '"', "'", "&", ";", ",", "//", "x.y-z", "hunter2", "é", ")", "0", "?"]), max_size=30))
def test_assigned_values_match_a_plain_walk(parts):
    text = "".join(parts)
    assert set(secret_scan.assigned_values(text)) == plain_assigned(text)


def test_names_with_digits_and_of_any_length():
    cases = {
        "password1=hunter2": "hunter2", "DB_PASSWORD_2: s3cretpw": "s3cretpw",
        "very_long_environment_variable_name_password=abc123xyz": "abc123xyz", "x" * 300 + "_token=abcd1": "abcd1",
        "https://h/p?user=jane&api_key=k3yk3y&next=home": "k3yk3y",
    }
    for text, value in cases.items():
        assert value in [c[2] for c in secret_scan.find_candidates(text)], text
    blob = "Zx9" * 1_000 + ",secret=qwerty12," + "qq=1," * 2_000 + "token=zyxw98"
    values = [c[2] for c in secret_scan.find_candidates(blob)]
    assert "qwerty12" in values and "zyxw98" in values  # all of a very long word's values


def test_words_assigned_to_credentials_are_no_secrets(spark):
    rnd = random.Random(5)
    key = lambda: "".join(rnd.choices(string.ascii_letters + string.digits, k=rnd.randint(10, 24)))
    prose = "please enter the required value of your account before the economy of the recipe changes".split()
    keys = [f"{' '.join(rnd.sample(prose, 5))} {rnd.choice(['password', 'api_key', 'token', 'db_secret_2'])}={key()} {' '.join(rnd.sample(prose, 4))}" for _ in range(200)]
    false = [f"{' '.join(rnd.sample(prose, 5))} password: required and secret: ingredient or token: economy {' '.join(rnd.sample(prose, 4))}" for _ in range(200)]
    rows = [(i, t, "en", "notes/app.md", "v", "n", 1) for i, t in enumerate(keys + false)]
    got = {r["doc_id"]: r["n_secrets"] for r in secret_scan.secret_scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(got[i] > 0 for i in range(200)) >= 190
    assert sum(got[i] > 0 for i in range(200, 400)) < 10


def test_evidence_is_the_value_s():
    language = secret_scan.Language.of(["please", "required", "ingredient", "economy", "password", "value", "account", "changes", "recipe", "before"])
    of = lambda value, name="password": secret_scan.evidence(value, name, language)
    assert of("required") == of("please value") == of("2024-01-02") == of("12345678") == 0
    assert of("x9Kq2LmZ7p") == of("qzxkvjwq") == 1 and of("x9Kq2LmZ7p", "commit") == 0
    assert of("AKIA" + "Q" * 16, "") == 1
