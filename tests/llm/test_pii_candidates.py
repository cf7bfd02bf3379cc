import pytest

from quarrylens.llm import pii


@pytest.mark.parametrize("text", ["jane at example dot com", "jane at\nexample dot com", "jane\nat example dot com", "jane\tat\texample dot com", "jane at example.com", "jane(at)example.com", "jane [AT] example [dot] com", "jane{at}\nexample.com", "jane @ example.com", "fe80:0:0::1", "::1 2001:db8::ff", "10.0.0[.]1", "4111 1111 1111 1111", "0049 30 123456"])
def test_every_match_of_a_generator_is_proposed_in_its_own_text(text):
    for n, (_, pattern) in enumerate(pii.GENERATORS):
        for m in pattern.finditer(text):
            assert any(g == n for g, *_ in pii.candidates(m[0])), (n, m[0])
