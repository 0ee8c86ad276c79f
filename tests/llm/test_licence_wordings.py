"""Licences in wordings that the model was not trained on."""

import numpy as np

from matchloom.llm import licenses

# wordings by which the ways of training were chosen
STATED = {
    "apache-2.0": ["We chose Apache 2.0 for the whole code base", "Everything here is Apache-2.0 unless a header says otherwise", "Code: Apache License 2.0 / Data: none", "The runtime ships with an Apache 2.0 licence", "Use it as the Apache License, Version 2.0 permits"],
    "mit": ["MIT licensed; the full text is in LICENSE.md", "Feel free to fork: the MIT License lets you", "This gem is open source and MIT licensed", "MIT licensed, see LICENSE for details", "Code under MIT, have fun", "The plugin comes with an MIT license"],
    "gpl": ["GPLv3 holds for every source file in this tree", "As GPL software it comes with absolutely no warranty", "This module is free software under the GNU GPL, either version 2 or any newer one", "Kernel parts remain GPL-2.0", "Ported from a GPLv2 driver, so GPLv2 it stays"],
    "lgpl": ["Link against it freely, it is LGPL code", "The bindings are LGPLv3", "Shared objects remain under LGPL 2.1"],
    "agpl": ["The server part is AGPLv3", "Anyone who hosts it has to follow the AGPL", "Community edition: GNU Affero GPL, version 3"],
    "bsd": ["BSD-licensed, as ever", "We give you this tool with the usual 3-clause BSD license", "New code goes in with a BSD license header", "The parser was taken over together with its BSD-2-Clause notice"],
    "mpl-2.0": ["Files with this header stay MPL 2.0", "Mozilla Public License 2.0 for the core, nothing else", "Each of the plugins is MPL-2.0"],
    "cc-by": ["Figures may be reused (CC BY 4.0)", "Text and pictures: CC-BY, name the author please", "Our lessons carry a Creative Commons Attribution license"],
    "cc-by-sa": ["All articles of this wiki are CC BY-SA 3.0", "Share the map as CC BY-SA", "Photographs by the club, Creative Commons Attribution-ShareAlike 4.0"],
    "cc-by-nc": ["The recordings are free for schools, CC BY-NC 4.0", "Worksheets: Creative Commons BY-NC, no resale", "CC BY-NC applies to the drawings"],
    "public-domain": ["The author waives all claims with CC0", "These scans are in the public domain", "I put this script into the public domain", "Data set: CC0 1.0, no strings attached"],
    "all-rights-reserved": ["(c) 2014 Harbour Press, all rights reserved.", "All rights reserved by the museum", "Copyright 1999-2003 North Lines Ltd. All Rights Reserved worldwide."],
}
UNSTATED = [
    "He showed his license to the officer and drove on", "MIT students released a study of the river", "The Apache web server answered slowly under the load", "A library is open to the general public",
    "All seats are reserved for members of the foundation", "The version of the story that he told was free of any doubt", "Terms of use of the room are on the door", "This work is under review",
    "The city issued a new license to the shop under the bridge", "Rights of way are public in this domain of the park", "The software was published by the author", "GNU is an animal of the plains, in general",
    "Released under the Server Side Public License", "PostgreSQL License, see the file COPYING", "Licensed under the Python Software Foundation License", "The trailer was released under the title Dawn",
    "A professor of MIT and two of Harvard signed the letter", "The Apache helicopter was covered by a tarpaulin", "BSD and Linux are two families of systems", "Our driver has no valid licence for this vehicle",
    "The general was made public enemy by the new law", "Mozilla moved its office in May", "Creative people have much in common", "The rights of the child are the subject of the lecture",
    "The pub lost its license to sell spirits", "Under the terms of the lease the tenant pays the water", "Free copies of the map lie in the foyer", "A free software festival was held in the park",
    "Dogs must be licensed in this county", "The public license office opens at nine", "She is licensed to practise medicine in two states", "They moved from version 2.0 to version 3 in a week",
]

# wordings that played no part in that
LATER = {
    "apache-2.0": ["Both crates carry Apache-2.0 headers", "Reuse is fine within Apache License 2.0", "Licence of the examples: Apache 2"],
    "mit": ["An MIT license goes with each release", "Think of it as MIT license plus good manners", "Icons and fonts come under the MIT licence"],
    "gpl": ["GPLv3 applies to all source files in this tree", "Any fork must be GPLv2 as well", "Ships with the GNU General Public License attached"],
    "lgpl": ["Dynamic linking is fine as the codec is LGPL-2.1", "Wrapper and codec: LGPLv3"],
    "agpl": ["Running it as a service means AGPL-3.0 duties", "AGPLv3 for all, no exceptions"],
    "bsd": ["Nothing but a 2-clause BSD license stands between you and the code", "The daemon kept its BSD licence to this day"],
    "mpl-2.0": ["Covered by MPL 2.0", "Changed files must stay under the Mozilla Public License"],
    "cc-by": ["Slides: CC BY 4.0", "Credit us as CC BY 3.0 asks"],
    "cc-by-sa": ["Adapted from a CC BY-SA 4.0 page", "Every map tile is CC BY-SA"],
    "cc-by-nc": ["Not for sale (CC BY-NC 4.0)", "Home use only: CC BY-NC 3.0"],
    "public-domain": ["Sounds are CC0", "Old plates, now in the public domain"],
    "all-rights-reserved": ["2021 The Quiet Company - all rights reserved", "Printed in Leeds. All rights reserved. First edition"],
}
LATER_UNSTATED = [
    "The committee of MIT voted against it", "Apache is a town in Oklahoma", "He was fined for fishing without a license", "The general spoke in public for two hours",
    "Version 2.0 of the plan is on the table", "The works of the artist are in the museum", "The shop is under new management", "Licensed under the Eclipse Public License",
    "The attribution of the painting is doubtful", "Mozilla and its friends met in Berlin", "The commons were fenced by the lords", "Rights and permissions are handled by the secretary",
]


def runs(words):
    return " " + " ".join(words) + " "


def test_wordings_hold_nothing_that_was_trained_on():
    names = [n for f in licenses.NAMES.values() for n in f]
    frames = {runs(licenses._words(f.format(n))) for f in licenses.FRAMES for n in names}
    later = [t for texts in LATER.values() for t in texts]
    statements = [runs(licenses._words(s)) for f, texts in licenses.STATEMENTS.items() if f != "all-rights-reserved" for s in texts]
    assert not [t for t in later for s in [*statements, *frames] if s in runs(licenses._words(t))]


def found(spark, texts):
    """family, probability, confirmed of each text, or None."""
    model = licenses.fit([f"the river was high in spring {i} and the boats lay in the harbour" for i in range(200)])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: (r["family"], r["probability"], r["confirmed"]) for r in licenses.scan(df, model).collect()}
    return [out.get(i) for i in range(len(texts))]


def test_licences_in_wordings_that_were_held_out(spark):
    for stated, unstated in ((STATED, UNSTATED), (LATER, LATER_UNSTATED)):
        pairs = [(f, t) for f, texts in stated.items() for t in texts] + [(None, t) for t in unstated]
        out = found(spark, [t for _, t in pairs])
        named = [(f, o[0] if o and o[2] else None) for (f, _), o in zip(pairs, out, strict=True)]
        right = sum(f is not None and f == o for f, o in named)
        claimed = sum(o is not None for _, o in named)
        for family in stated:
            mine = [o for f, o in named if f == family]
            print(family, "recall", mine.count(family) / len(mine), "others called so", sum(o == family and f != family for f, o in named))
        sure = [(o[1], o[0] == f) for (f, _), o in zip(pairs, out, strict=True) if o]
        gap = abs(np.mean([p for p, _ in sure]) - np.mean([hit for _, hit in sure]))
        print("recall", right / sum(map(len, stated.values())), "precision", right / claimed, "mean probability less share right", gap)
        assert right >= 0.8 * sum(map(len, stated.values()))
        assert right >= 0.95 * claimed
        assert gap <= 0.2
