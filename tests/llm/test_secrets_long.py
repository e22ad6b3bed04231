"""Operator 10 on long texts (time in proportion to the text) and on long words (no finding)."""

import random
import string
import time

import pytest

from volspan.llm import secrets

BASE62 = string.ascii_letters + string.digits
#: Long words of two languages, umlauts written as two letters.
ENGLISH = """antidisestablishmentarianism pneumonoultramicroscopicsilicovolcanoconiosis floccinaucinihilipilification pseudopseudohypoparathyroidism psychoneuroendocrinological
hepaticocholangiogastrostomy spectrophotofluorometrically thyroparathyroidectomized honorificabilitudinitatibus supercalifragilisticexpialidocious electroencephalographically
uncharacteristically counterrevolutionaries internationalization incomprehensibilities deinstitutionalization hypercholesterolemia radioimmunoelectrophoresis Immunoelectrophoretically
COUNTERDEMONSTRATIONS""".split()
GERMAN = """Donaudampfschifffahrtsgesellschaftskapitaen rechtsschutzversicherungsgesellschaften kraftfahrzeughaftpflichtversicherung geschwindigkeitsbegrenzungen Bundesausbildungsfoerderungsgesetz
siebenhundertsiebenundsiebzigtausend arbeiterunfallversicherungsgesetz streichholzschaechtelchen freundschaftsbezeigungen nahrungsmittelunvertraeglichkeit Lebensversicherungsgesellschaft
sozialversicherungsfachangestellter Verkehrsinfrastrukturfinanzierungsgesellschaft betaeubungsmittelverschreibungsverordnung Jahreshauptversammlungen schwangerschaftsabbruch""".split()


def texts():
    r = random.Random(9)
    blob = "".join(r.choices(BASE62, k=1_000_000))
    return {
        "blob": blob, "one case": "".join(r.choices(string.ascii_lowercase, k=1_000_000)), "no secret": "ab" * 500_000, "scheme characters": "a.b-c+" * 160_000,
        "urls": " ".join(f"https://h{k}.example.com/a/{r.randint(0, 9**9)}/{''.join(r.choices(BASE62, k=30))}" for k in range(20_000)),
        "joined urls": "".join(f"https://h{k}.example.com/{''.join(r.choices(BASE62, k=24))}" for k in range(20_000)),
        "hex": " ".join("".join(r.choices("0123456789abcdef", k=32)) for _ in range(20_000)), "joined hex": "_".join("".join(r.choices("0123456789abcdef", k=32)) + "GhZ7" for _ in range(20_000)),
        "schemes": "://" * 300_000, "assignments": "token=" * 150_000, "addresses": "a.b@" * 250_000, "words": "Word-" * 200_000,
    }


@pytest.mark.parametrize("name", sorted(texts()))
def test_time_follows_the_length(name):
    text = texts()[name]
    secrets.default_pairs()
    began = time.process_time()
    secrets.scan(text)
    long = time.process_time() - began
    began = time.process_time()
    for k in range(4):
        secrets.scan(text[k * len(text) // 8 : (k + 1) * len(text) // 8])
    half = time.process_time() - began
    # Half the text in four pieces; a quadratic scan of the whole would take sixteen times as long.
    assert long < 4 * half + 1.5
    if name in ("blob", "urls", "hex"):
        assert long < 2.5


def test_redacting_a_long_text():
    blob = texts()["blob"]
    began = time.process_time()
    out = secrets.redact_text(f"see {blob} there")
    assert time.process_time() - began < 2.5
    assert out.startswith("see [SECRET]") and out.endswith(" there") and len(out.replace("[SECRET]", "")) < 1000


@pytest.mark.parametrize("word", [*ENGLISH, *GERMAN])
def test_long_words_are_no_secrets(word):
    for text in (word, f"see {word} there", f"({word})", f"{word}-{word}2", word.upper(), word.capitalize()):
        assert secrets.scan(text) == []


def test_random_letters_still_are():
    r = random.Random(2)
    for alphabet in (string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters):
        found = [bool(secrets.scan("key " + "".join(r.choices(alphabet, k=40)) + " end")) for _ in range(300)]
        assert sum(found) > 290
