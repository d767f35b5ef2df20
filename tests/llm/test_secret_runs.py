import random
import string

import public_tokenizers
import pytest

from lumenward.llm import op3_byte_bpe
from lumenward.llm.byte_bpe import codec
from lumenward.llm.secret_scan import random_spans

CODEC = codec(public_tokenizers.path(op3_byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
PREFIXES = ["", "documentation/configuration/integration/", "my-api-key="]


def _spans(text, **options):
    return random_spans(text, lambda run: len(CODEC.encode(run)), **options)


@pytest.mark.parametrize("prefix", PREFIXES)
@pytest.mark.parametrize("alphabet, least", [
    (string.ascii_letters, 196), (string.ascii_uppercase, 196), (string.ascii_lowercase, 180),
    (string.ascii_letters + string.digits, 198), (string.ascii_letters + string.digits + "+/", 196)])
def test_random_strings_of_any_alphabet_behind_words(alphabet, least, prefix):
    rng = random.Random(5)
    keys = ["".join(rng.choice(alphabet) for _ in range(24)) for _ in range(200)]
    assert sum(any(end > len(prefix) + 20 for _, _, end in _spans(prefix + k)) for k in keys) >= least


def test_words_stay():
    for clean in ("unexceptionalwordsofgreatlength", "__init_subclass_hook__", "abcdefabcdefabcdefabcde",
                  "documentation/configuration/integration/overview", "AbstractConnectionFactoryBuilder",
                  "CONNECTION_TIMEOUT_IN_SECONDS", "----------------------x", "x" * 5000):
        assert _spans(f"see {clean} there") == [], clean


@pytest.mark.parametrize("length, least, found", [(16, 16, 0.97), (16, 12, 0.97), (12, 12, 0.95), (16, 20, 0), (12, 16, 0), (20, 20, 0.97), (20, 16, 0.97)])
def test_floors(length, least, found):
    """Random strings are found from the floor on; letters of one case only from 20 on."""
    rng = random.Random(7)
    for alphabet in (string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, "0123456789abcdef", string.ascii_letters + "0123456789-_"):
        keys = ["".join(rng.choice(alphabet) for _ in range(length)) for _ in range(200)]
        share = sum(bool(_spans(f"see {k} end", least=least)) for k in keys) / len(keys)
        assert (share >= found if found else share == 0), (alphabet, share)
    lower = ["".join(rng.choice(string.ascii_lowercase) for _ in range(length)) for _ in range(200)]
    assert sum(bool(_spans(k, least=least)) for k in lower) >= (190 if length >= 20 else 0)


NAMES = """2024-01-01T00-00-00Z_backup v1_2_3-rc4_build20240101 x86_64-unknown-linux-gnu ACGTACGGTCATTACGATCAGGTACCA
    AbstractConnectionFactoryBuilder CONNECTION_TIMEOUT_IN_SECONDS getElementsByClassName XMLHttpRequestUpload internationalization
    /usr/local/lib/python3.13/site-packages en_US-UTF-8-posix 2023-12-31T23-59-59-0500 release-2024.10.3-beta libstdc++-6-dev
    java/util/concurrent/ConcurrentHashMap kubernetes-ingress-controller-v2 my_very_long_variable_name_17 img_20240131_235959_001
    IMG-20240131-WA0007 DSC_0001_edited-1 section-4-subsection-2-part-b utf8mb4_unicode_520_ci arm64-apple-darwin21 aarch64-linux-android21
    chapter12_section3_figure7 2001-0db8-85a3-0000-0000-8a2e-0370-7334 test_case_0001_expected_output foo=bar1/baz=qux2/part-00001
    year=2024/month=01/day=31 gcc-13-x86-64-linux-gnu ubuntu-22-04-lts-amd64 jquery-3-7-1-min-js bootstrap-5-3-0-dist
    spark-4-1-2-bin-hadoop3 openjdk-17-jre-headless session_id_cookie_name_v2 application/vnd-api+json UnsupportedOperationException
    thisisaverylongwordwithoutspaces supercalifragilisticexpialidocious Donaudampfschifffahrtsgesellschaft
    antidisestablishmentarianism pneumonoultramicroscopicsilicovolcanoconiosis user-12345-profile-67890 order_2024_000123_final
    invoice-INV-2024-00042 RFC-2616-section-14 ISO-8601-2004-E ISBN-978-3-16-148410-0 A4-B5-C6-D7-E8-F9 1e3/2e5=3e7-4e9
    ABCDEFGHIJKLMNOPQRST abcdefghijklmnopqrstuvwxyz 0123456789abcdefghij qwertyuiopasdfgh AAAAAAAAAAAAAAAAAAAA""".split()


@pytest.mark.parametrize("least", [16, 20])
def test_names_dates_and_versions_stay(least):
    assert [n for n in NAMES if _spans(f"see {n} there", least=least)] == []


def test_keys_beside_names_are_found():
    key = "x9Kq2LmZ8vB4tR7w"
    for name in NAMES[:30]:
        assert any(text[a:b].find(key) >= 0 for text in [f"{name}/{key}", f"{name} {key}"] for _, a, b in _spans(text)), name
