"""Licences by SPDX ids and short names."""

import random
import time

import pytest

from ridgeline.llm import license_scan


#: SPDX ids and short names by family.
SHORT = {
    "mit": ("mit", "x11", "expat"), "isc": ("isc",), "apache": ("apache", "apache2"), "gpl": ("gplv1", "gplv2", "gplv3"), "lgpl": ("lgplv2", "lgplv3"), "agpl": ("agplv3",),
    "gfdl": ("gnu fdl",), "bsd": ("bsd",), "edl": ("edl",), "cpl": ("cpl",), "artistic": ("artistic", "clartistic"), "zlib": ("zlib", "libpng"),
    "boost": ("boost",), "odbl": ("open database",), "ofl": ("ofl", "sil ofl"), "psf": ("psf",), "python": ("python", "cnri python"), "php": ("php",), "ruby": ("ruby",),
    "postgresql": ("postgresql",), "openssl": ("openssl", "ssleay"), "curl": ("curl",), "ncsa": ("ncsa",), "academic-free": ("afl",), "open-software": ("osl",),
    "upl": ("upl",), "mulan": ("mulanpsl",), "elastic": ("elastic",),
}


def labels(text):
    return [(label, score) for _, _, _, label, score in license_scan.Scanner().detect(license_scan.normalised(text)[0])]


@pytest.mark.parametrize(("family", "name"), [(f, n) for f, names in SHORT.items() for n in names])
def test_short_names(family, name):
    got = license_scan.Scanner()
    for text, score in ((f"SPDX-License-Identifier: {name.replace(' ', '-').upper()}", 0.99), (f"It is released under {name}.", 0.95)):
        found = got.detect(license_scan.normalised(text)[0])
        assert [(x[3], x[4]) for x in found] == [(family, score)], text


@pytest.mark.parametrize(("spdx", "family"), [("MIT", "mit"), ("MIT-0", "mit-0"), ("Apache-2.0", "apache"), ("ISC", "isc"), ("BSD-3-Clause", "bsd-3-clause"), ("GPL-2.0-only", "gpl"), ("CC-BY-SA-4.0", "cc-by-sa"), ("Python-2.0", "python"), ("Zlib", "zlib"), ("PHP-3.01", "php"), ("AFL-3.0", "academic-free"), ("OFL-1.1", "ofl")])
def test_spdx_ids(spdx, family):
    assert labels(f"// SPDX-License-Identifier: {spdx}\nint x;") == [(family, 0.99)]


def test_short_statements():
    assert labels("This is licensed under Apache 2.0") == [("apache", 0.95)]
    assert labels("Code here is released under MIT") == [("mit", 0.95)]
    assert labels("wir gehen mit python 3 und apache; curl is nice, boost too") == []
    assert labels("Licensed under BSD-3-Clause.") == [("bsd-3-clause", 0.95)]
    assert labels("Licensed under MIT-0.") == [("mit-0", 0.95)]
    assert labels("Licensed under the MIT License.") == [("mit", 0.95)]


def test_suppression_against_a_plain_scan():
    rng = random.Random(3)
    for n in (0, 1, 5, 60, 300):
        found = [(a, a + rng.randrange(1, 40), i % 17 * 1000 + i, "x", 1.0) for i, a in enumerate(rng.randrange(400) for _ in range(n))]
        want = [m for m in found if not any(h[2] < m[2] and h[0] <= m[0] and h[1] >= m[1] for h in found)]
        assert license_scan.standing(found) == sorted(want)


def test_every_rule_by_a_plain_scan():
    """Without the keyword gate the same rules match: no rule needs a word that its matches lack."""
    scanner = license_scan.Scanner()
    texts = [f"SPDX-License-Identifier: {x}" for x in ("GPL-2.0-or-later", "CC-BY-NC-ND-4.0", "0BSD", "MS-PL", "CECILL-B")]
    texts += ["released under the European Union Public Licence v1.2", "distributed under Creative Commons Attribution Non-Commercial Share-Alike 4.0", "LGPLv2.1+ or MPL 2.0, simplified BSD license", "all rights reserved. Academic Free License 3.0; Beerware license", "the software shall be used for good, not evil"]
    for text in texts:
        padded, _ = license_scan.normalised(text)
        everything = [(*m.span(), i, r.label, r.score) for i, r in enumerate(scanner.rules) for m in r.pattern.finditer(padded)]
        assert scanner.detect(padded) == license_scan.standing(everything) and everything, text


def test_long_texts_in_little_time():
    padded, n = license_scan.normalised("licensed under the MIT license, all rights reserved " * 10_000)
    began = time.time()
    found = license_scan.Scanner().detect(padded)
    assert len(found) == 20_000 and license_scan.word_index(padded, [x[1] for x in found])[-1] == n
    assert time.time() - began < 5
