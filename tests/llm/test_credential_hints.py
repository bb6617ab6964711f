import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvex.llm import credentials

VALUE = "aB3dE5gH7jK9mN1pQ3"
LINES = ['auth: { user: "bot", pass: "%s" }', 'const dbPass = "%s";', '"rootPw": "%s"', "smtp.pass=%s", "run --pass %s", 'mapsKey: "%s"', 'siteAuth = "%s"']


@pytest.mark.parametrize("line", LINES)
def test_lines_of_every_notation_are_read(line):
    text = "x\n" + line % VALUE + "\n"
    assert [text[a:b] for a, b in credentials.find_credentials(text)] == [VALUE]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["db", "Pass", "pw", "PWD", "maps", "Key", "auth", "token", "secret", "api", "clientsec", "ret", "_", "-", ".", "1", "credentials", "access", "id"]), min_size=1, max_size=5).map("".join))
def test_every_key_passes_the_hints(key):
    if credentials.key_kind(key):
        assert next(credentials._hint_places(key.lower()), None) is not None
