import random

import pytest

from corvex.llm import credentials

TOKEN = "".join(random.Random(2).choice("abcdefghkmABCDEFGHKM23456789") for _ in range(1500))


@pytest.mark.parametrize("before, after", [('token="', '"'), ("--token=", " "), ("Authorization: Bearer ", "'"), ("https://u:", "@h.example"), ("ghp_", " ")])
def test_values_across_a_window_are_whole(before, after):
    lead = "a;" * 1450
    text = lead + before + TOKEN + after + ";b" * 3000
    want = ("ghp_" if before == "ghp_" else "") + TOKEN
    assert [text[a:b] for a, b in credentials.find_credentials(text)] == [want]
