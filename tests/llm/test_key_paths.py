import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvex.llm import credentials, keypaths

S = "Zx9kQw77LmPq"
CASES = [
    ("a.yaml", f'api_key:\n  value: "{S}"\n', [S]),
    ("a.json", f'{{"credentials": {{"value": "{S}"}}}}', [S]),
    ("a.xml", f"<c>\n<password>{S}</password></c>", [S]),
    ("a.config", f'<cfg><add key="ApiKey" value="{S}"/></cfg>', [S]),
    ("a.yml", f"env:\n- name: DB_PASSWORD\n  value: {S}\n- name: X\n  value: other\n", [S]),
    ("a.yml", f"db:\r\n  password: |\r\n    {S}\r\n  user: me\r\n", [S]),
    ("a.json", f'{{"name": "DB_PASSWORD", "value": "{S}"}}', [S]),
    ("conf/.env", "password = correct_horse_9\n", ["correct_horse_9"]),
    ("a.py", f'pw = "{S}"', [S]),
    (None, f'pass = "{S}"', [S]),
    ("a.yaml", f"smtp:\n  pass: {S}\n", [S]),
    ("a.json", f'{{"password":\n   "{S}"}}', [S]),
    ("a.toml", f'[db]\nhost = "x"\n[db.auth]\nkey = "{S}"\n', [S]),
    ("a.toml", f'a = {{password = "{S}", b = 2}}', [S]),
    ("a.yaml", f'auth: {{ user: "bot", pass: "{S}" }}', [S]),
    ("a.properties", f"spring.datasource.password={S}\n", [S]),
    ("a.plist", f"<dict><key>Password</key><string>{S}</string></dict>", [S]),
    ("a.resx", f'<data name="Password"><value>{S}</value></data>', [S]),
    ("a.ini", f"[smtp]\npassword =\n    {S}\n", [S]),
    ("a.yaml", "é: ü\npassword: \"pä77ßwörd\"\n", ["pä77ßwörd"]),
    ("a.yaml", "password: ${DB_PASSWORD}\ntoken: !vault x\nsecret_ref: abc\npassword: string\npassword_file: /etc/x\ntoken: *other\n", []),
    ("a.json", '{"properties": {"password": {"type": "string", "description": "the password of"}}}', []),
    ("a.json", '{"apiKeyName": "X-Api-Key", "token": {"default": "none"}, "password": "/etc/app/password.txt"}', []),
    ("a.md", f"lin_ring 37\rwebhook_secret: FUMz0SyTF5RVB2yv3u5CBB7LOjfwfb7J\r* x 15\r\nPWD={S}\r7.65", ["FUMz0SyTF5RVB2yv3u5CBB7LOjfwfb7J", S]),
    ("a.env", "def f(x):\n    token = row.next_token\n    return token(x);\n", []),
]


@pytest.mark.parametrize("path, text, want", CASES)
def test_configuration(path, text, want):
    spans = credentials.find_credentials(text, path)
    assert [text[a:b] for a, b in spans] == want
    masked = credentials.masked(text, spans)
    for w in want:
        text = text.replace(w, "*****")
    assert masked == text


def test_paths_and_offsets():
    text = 'a:\n  - b: "x y"\n    c: [1, {d: e}]\n# c\nf: >-\n  one\n  two\n'
    got, literal = keypaths.entries(text, "x.yaml")
    assert literal and [(e.path, text[e.start : e.end]) for e in got] == [(("a", "b"), "x y"), (("a", "c"), "1"), (("a", "c", "d"), "e"), (("f",), "one\n  two")]
    assert [(e.path, '{"a": [1, {"b": "c"}], "d": null}'[e.start : e.end]) for e in keypaths.json_entries('{"a": [1, {"b": "c"}], "d": null}')] == [(("a",), "1"), (("a", "b"), "c"), (("d",), "null")]


@pytest.mark.parametrize("path", ["a.json", "a.yaml", "a.toml", "a.xml", None])
def test_odd_and_long_texts_end(path):
    for text in ("", " ", "[" * 50_000, '{"a":' * 30_000, "<a>" * 30_000, "- " * 30_000, "a: {" * 20_000, '"' * 50_001, "key: 'x\n" * 20_000, "<a b='" * 20_000, "\r" * 1000, f'{{"k": "{"x" * 200_000}"}}'):
        began = time.perf_counter()
        credentials.find_credentials(text, path)
        assert time.perf_counter() - began < 5


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab:='\"/<>{}[]-|# \n\r;,password", max_size=120), st.sampled_from(["a.json", "a.yaml", "a.ini", "a.xml", None]))
def test_any_text_has_spans_in_order(text, path):
    spans = credentials.find_credentials(text, path)
    assert all(0 <= a < b <= len(text) for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    for reader in (keypaths.json_entries, keypaths.yaml_entries, keypaths.section_entries, keypaths.xml_entries):
        assert all(0 <= e.start <= e.end <= len(text) for e in reader(text))


def test_redaction_keeps_all_other_bytes(spark):
    texts = {1: f'\ufeff<c>\r\n<password>{S}</password>\r ä</c>', 2: "é: 1\npassword: 'pä77ß'\n", 3: None, 4: ""}
    df = spark.createDataFrame([(k, t, "x.xml" if k == 1 else "x.yml") for k, t in texts.items()], "file_id long, content string, path string").withColumn("_p", df_clash())
    out = {r.file_id: r.redacted for r in credentials.redact(df, path="path").collect()}
    assert out == {1: texts[1].replace(S, "*****"), 2: texts[2].replace("pä77ß", "*****"), 3: None, 4: ""}
    assert {tuple(r) for r in credentials.credentials(df, path="path").collect()} == {(1, 2, S), (2, 2, "pä77ß")}


def df_clash():
    from pyspark.sql import functions as F

    return F.lit("clash")
