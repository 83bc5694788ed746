"""Signature rules of license notices: a few wordings for each license family, and passages of license texts.

A rule is (name, label, gate, keys, pattern, weight). Every match contains the plain string ``gate`` and one of ``keys``, which is
checked before the pattern runs. Patterns read lower-cased text; a blank in them stands for any white space, so no gate or key
holds one. Earlier rules have priority.
"""

from __future__ import annotations

# Own choice of rules: label, keys (one of them is in every name, identifier and address), SPDX identifiers (pattern), names (pattern), address (pattern or "").
FAMILIES = [
    ("agpl", "affero agpl", r"agpl-[13]\.0", r"(gnu )?affero general public licen[sc]e|(gnu )?agpl", r"gnu\.org/licenses/agpl"),
    ("lgpl", "lesser library lgpl", r"lgpl-[23]\.[01]", r"(gnu )?(lesser|library) general public licen[sc]e|(gnu )?lgpl", r"gnu\.org/licenses/lgpl"),
    ("gfdl", "documentation gfdl fdl", r"gfdl-1\.[123]", r"gnu free documentation licen[sc]e|gfdl", r"gnu\.org/licenses/fdl"),
    ("gpl", "general gpl", r"gpl-[123]\.0", r"gnu general public licen[sc]e|gnu gpl|gpl ?v?[23]", r"gnu\.org/licenses/gpl"),
    ("apache", "apache", r"apache-[12]\.[01]", r"apache licen[sc]e|apache software licen[sc]e", r"apache\.org/licenses"),
    ("mit", "mit expat", r"mit", r"mit licen[sc]e|mit/x11 licen[sc]e|expat licen[sc]e", r"opensource\.org/licenses/mit"),
    ("bsd-2-clause", "bsd", r"bsd-2-clause", r"(simplified|two-clause|2-clause|freebsd) bsd licen[sc]e|bsd 2-clause licen[sc]e", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"bsd-3-clause", r"(new|modified|revised|three-clause|3-clause) bsd licen[sc]e|bsd 3-clause licen[sc]e", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd", "bsd", r"bsd-4-clause|0bsd", r"bsd-style licen[sc]e|bsd licen[sc]e", r"opensource\.org/licenses/bsd-license"),
    ("isc", "isc", r"isc", r"isc licen[sc]e", r"opensource\.org/licenses/isc"),
    ("mpl", "mozilla mpl", r"mpl-[12]\.[01]", r"mozilla public licen[sc]e|mpl ?v?[12]\.[01]", r"mozilla\.org/(en-us/)?mpl"),
    ("epl", "eclipse epl", r"epl-[12]\.0", r"eclipse public licen[sc]e", r"eclipse\.org/legal/epl"),
    ("cddl", "distribution cddl", r"cddl-1\.[01]", r"common development and distribution licen[sc]e", r"opensource\.org/licenses/cddl"),
    ("eupl", "european eupl", r"eupl-1\.[0-2]", r"european union public licen[sc]e", r"joinup\.ec\.europa\.eu/.{0,40}eupl"),
    ("artistic", "artistic", r"artistic-[12]\.0", r"artistic licen[sc]e", r"opensource\.org/licenses/artistic"),
    ("zlib", "zlib", r"zlib", r"zlib licen[sc]e|zlib/libpng licen[sc]e", r"opensource\.org/licenses/zlib"),
    ("boost", "boost bsl-1", r"bsl-1\.0", r"boost software licen[sc]e", r"boost\.org/license_1_0"),
    ("unlicense", "unlicense", r"unlicense", r"the unlicense", r"unlicense\.org"),
    ("wtfpl", "want wtfpl", r"wtfpl", r"do what the f\S{1,6} you want to public licen[sc]e|wtfpl", r"wtfpl\.net"),
    ("python", "python psf", r"psf-2\.0|python-2\.0", r"python software foundation licen[sc]e|psf licen[sc]e", r"python\.org/.{0,20}license"),
    ("postgresql", "postgresql", r"postgresql", r"postgresql licen[sc]e", r"postgresql\.org/about/licen[sc]e"),
    ("openssl", "openssl", r"openssl", r"openssl licen[sc]e", r"openssl\.org/source/license"),
    ("ofl", "open ofl", r"ofl-1\.[01]", r"sil open font licen[sc]e|open font licen[sc]e", r"scripts\.sil\.org/ofl"),
    ("odbl", "database odbl", r"odbl-1\.0", r"open database licen[sc]e|odbl", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "attribution odc-by opendatacommons", r"odc-by-1\.0", r"open data commons attribution licen[sc]e", r"opendatacommons\.org/licenses/by"),
    ("pddl", "dedication pddl", r"pddl-1\.0", r"public domain dedication and licen[sc]e", r"opendatacommons\.org/licenses/pddl"),
    ("cc0", "cc0 zero", r"cc0-1\.0", r"cc0( 1\.0)?( universal)?|creative commons zero", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-nc-sa", "cc creative", r"cc-by-nc-sa-[1-4]\.[05]", r"cc by-nc-sa|creative commons attribution-noncommercial-sharealike", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", "cc creative", r"cc-by-nc-nd-[1-4]\.[05]", r"cc by-nc-nd|creative commons attribution-noncommercial-noderiv(ative)?s", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc", "cc creative", r"cc-by-nc-[1-4]\.[05]", r"cc by-nc|creative commons attribution-noncommercial", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-sa", "cc creative", r"cc-by-sa-[1-4]\.[05]", r"cc by-sa|creative commons attribution-sharealike", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-nd", "cc creative", r"cc-by-nd-[1-4]\.[05]", r"cc by-nd|creative commons attribution-noderiv(ative)?s", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by", "cc creative", r"cc-by-[1-4]\.[05]", r"cc by|creative commons attribution", r"creativecommons\.org/licenses/by/"),
    ("openrail", "rail bigscience", r"openrail(-m)?", r"(creativeml )?open ?rail(-m)?( licen[sc]e)?", r"bigscience\.huggingface\.co/.{0,20}license"),
    ("llama", "llama", r"llama[23]?", r"llama [23]? ?community licen[sc]e", r"llama\.com/.{0,20}license"),
    ("ms-pl", "microsoft ms-pl", r"ms-pl", r"microsoft public licen[sc]e", r"opensource\.org/licenses/ms-pl"),
    ("sspl", "server sspl", r"sspl-1\.0", r"server side public licen[sc]e", r"mongodb\.com/licensing/server-side-public-license"),
    ("busl", "business busl mariadb", r"busl-1\.1", r"business source licen[sc]e", r"mariadb\.com/bsl11"),
    ("elastic", "elastic", r"elastic-2\.0", r"elastic licen[sc]e", r"elastic\.co/licensing/elastic-license"),
    ("polyform", "polyform", r"polyform-[a-z-]+", r"polyform (noncommercial|small business|shield|strict) licen[sc]e", r"polyformproject\.org/licenses"),
]

# Own choice of wordings: wording, gate, weight; {n} is the family's name, {s} its identifier, {a} its address.
WORDINGS = [
    ("tag", r"spdx-license-identifier: ?({s})\b", "spdx-license-identifier", 1.0),
    ("granted", r"\b(is|are) (hereby )?licensed (to you )?under (the )?(terms of (the )?)?({n})\b(( licen[sc]e)?,? (version|v\.?) ?[0-9](\.[0-9])?| [0-9]\.[0-9])?", "licensed", 0.95),
    ("licensed", r"\blicen[sc]ed under (the )?(terms of (the )?)?({n})\b(( licen[sc]e)?,? (version|v\.?) ?[0-9](\.[0-9])?| [0-9]\.[0-9])?", "under", 0.9),
    ("released", r"\b(released|distributed|published|provided|(made )?available) under (the )?(terms of (the )?)?({n})\b", "under", 0.85),
    ("address", r"\bhttps?://(www\.)?({a})", "://", 0.8),
    ("named", r"\b({n})\b", "", 0.5),
]

# Passages of license texts and notices: name, label, gate, pattern, weight.
PASSAGES = [
    ("mit-grant", "mit", "permission", r"permission is hereby granted, free of charge, to any person obtaining a copy", 0.95),
    ("isc-grant", "isc", "permission", r"permission to use, copy, modify, and/or distribute this software for any purpose", 0.95),
    ("bsd-grant", "bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted", 0.9),
    ("bsd-endorse", "bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from", 0.85),
    ("gpl-grant", "gpl", "redistribute", r"this (program|library|file) is free software(;|:) you can redistribute it", 0.9),
    ("gpl-later", "gpl", "later", r"either version [23] of the licen[sc]e, or \(at your option\) any later version", 0.85),
    ("apache-grant", "apache", "compliance", r"you may not use this file except in compliance with the licen[sc]e", 0.9),
    ("mpl-grant", "mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e", 0.95),
    ("zlib-grant", "zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty", 0.85),
    ("unlicense-grant", "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0.95),
    ("public-domain", "public-domain", "domain", r"(dedicated to|released (in)?to|is in) the public domain", 0.7),
    ("no-warranty", "warranty-disclaimer", "warrant", r"without warrant(y|ies) of any kind", 0.4),
    ("reserved", "all-rights-reserved", "reserved", r"all rights reserved", 0.4),
    ("proprietary", "proprietary", "proprietary", r"(confidential and proprietary|proprietary and confidential)", 0.6),
    ("own-terms", "unknown-license", "licen", r"\b(see|under) the (enclosed |attached |accompanying )?licen[sc]e (file|agreement|terms)\b", 0.3),
]

# Own choice of gates: every match of any rule contains one of these, or fits DOCUMENT_PATTERN; all other documents are not scanned.
DOCUMENT_GATES = [
    "licen", "gpl", "gfdl", "mpl", "wtfpl", "odbl", "commons", "rail", "://", "permission", "redistribut", "endorse", "later", "compliance",
    "mozilla", "as-is", "unencumbered", "domain", "warrant", "reserved", "proprietary",
]
DOCUMENT_PATTERN = r"\bcc\s+by|\bcc0"


def _spaced(pattern: str) -> str:
    """Any white space for a blank."""
    return pattern.replace(" ?", r"\s*").replace(" ", r"\s+")


def rules() -> list[tuple[str, str, str, list[str], str, float]]:
    out = []
    for wording, shape, gate, weight in WORDINGS:
        for label, keys, spdx, names, address in FAMILIES:
            pattern = _spaced(shape.replace("{n}", names).replace("{s}", spdx).replace("{a}", address))
            out.append((f"{label}-{wording}", label, gate, keys.split(), pattern, weight))
    return out + [(name, label, gate, [gate], _spaced(pattern), weight) for name, label, gate, pattern, weight in PASSAGES]
