"""Names in other scripts become keys of Latin letters."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.functions.scripts import INDIAN, _indian

CASES = [
    ("Яндекс Такси ООО", "yandeks taksi ooo"), ("Щёлково", "shchyolkovo"), ("Київ", "kiyiv"), ("Θεσσαλονίκη Ψάρι", "thessaloniki psari"), ("شركة النور ٢٤", "shrka alnwr 24"), ("שלום", "shlvm"),
    ("राम मेडिकल", "ram medikal"), ("सत्यम", "satyam"), ("भारत पेट्रोलियम", "bharat petroliyam"), ("दिल्ली १२", "dilli 12"), ("लज़ीज़", "lajij"), ("কলকাতা", "kalakata"), ("ਪੰਜਾਬ", "panjab"), ("ગુજરાત", "gujarat"),
    ("தமிழ்", "tamil"), ("తెలుగు", "telugu"), ("ಬೆಂಗಳೂರು", "bengaluru"), ("മലയാളം", "malayalan"), ("Café राम", "cafe ram"), ("東京", "東京"), ("Plain Name Ltd", "plain name"),
]


def test_keys(spark):
    got = {r[0]: r[1] for r in spark.createDataFrame([(a,) for a, _ in CASES] + [(None,)], "n string").select("n", N.matching_key(F.col("n"))).collect()}
    assert got[None] is None
    wrong = {a: (got[a], b) for a, b in CASES if got[a] != b}
    assert not wrong


@pytest.mark.parametrize("script", INDIAN)
def test_every_letter_of_a_script_has_a_sound(spark, script):
    table, consonants, taking, _ = _indian(script, INDIAN[script])
    assert len(consonants) >= 20 and len(taking) >= 10 and all(v.isascii() for v in table.values())
    key = spark.createDataFrame([("".join(consonants),)], "n string").select(N.matching_key(F.col("n"))).first()[0]
    assert key.isascii() and len(key) > len(consonants)
