"""Random strings among words and without digits."""

import time

from presswork.llm import secret_scan

def test_random_parts_are_found_among_words_and_without_digits():
    import random
    import string

    rng, scanner = random.Random(1), secret_scan.Scanner()
    for alphabet, before in ((string.ascii_letters, "key "), (string.ascii_letters + string.digits, "at /account/reset-password/confirm/"),
                             (string.ascii_letters + string.digits, "at /download/customer-reports/archive/")):
        for n in (20, 32):
            for _ in range(100):
                text = before + "".join(rng.choices(alphabet, k=n)) + " end"
                assert any(k == 3 and b <= len(before) and e == len(text) - 4 for b, k, e in scanner.spans(text)[1]), text
    for text in ("/usr/local/share/applications/documentation-index", "see /files/123e4567-e89b-12d3-a456-426614174000/annual-report-final",
                 "Donaudampfschifffahrtsgesellschaftskapitaen", "--------------------------------", "=" * 40 + "/" * 40,
                 "sha512-" + "9fQz7LmX2vB8kTwR4sYp1cH" * 3 + "9fQz7LmX2vB8kTwRQ=="):
        assert not scanner.spans(text)[1], text
    begun = time.time()
    assert scanner.spans("q9X/" * 100_000)[1] and time.time() - begun < 20
