"""Licence notices that no template is made of, and near ones that are another licence's or none."""

from lodestar.llm import licenses

UNKNOWN = licenses.UNKNOWN
#: As they stand in files of many projects; none is a template.
HELD_OUT = [
    ("apache", "// Copyright 2019 The Authors\n// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//     http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "This project is licensed under the Apache License, Version 2.0 - see LICENSE."),
    ("apache", "# SPDX-License-Identifier: Apache-2.0\n# Copyright the contributors"),
    ("apache", "The code is released under the Apache-2.0 license."),
    ("mit", "This project is licensed under the MIT License - see the LICENSE.md file for details"),
    ("mit", "The MIT License (MIT)\n\nCopyright (c) 2015 A. Person"),
    ("mit", "/* SPDX-License-Identifier: MIT */"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files (the\n\"Software\"), to deal in the Software without restriction, including\nwithout limitation the rights to use, copy, modify, merge, publish"),
    ("gpl", " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl", "// SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl", "Distributed under the terms of the GPL-3.0 license."),
    ("lgpl", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "# SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("lgpl", "Released as LGPL-3.0 by its authors"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("agpl", "The server is AGPL-3.0."),
    ("bsd", "Copyright (c) 2010, Some Company. All rights reserved.\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice"),
    ("bsd", "Use of this source code is governed by a license. SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd", "This software is licensed under the BSD 3-Clause License, see LICENSE."),
    ("mpl", "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl", "SPDX-License-Identifier: MPL-2.0"),
    ("epl", "SPDX-License-Identifier: EPL-2.0"),
    ("epl", " * This program and the accompanying materials are made\n * available under the terms of the Eclipse Public License 2.0\n * which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("isc", "// SPDX-License-Identifier: ISC"),
    ("unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy, visit the site."),
    ("cc-by", "Text and figures: CC BY 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Photo by someone, CC BY-SA 4.0"),
    ("cc-by-nd", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc", "Data are shared as CC BY-NC 4.0 for research"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("proprietary", "Copyright 2021 Example Incorporated. All rights reserved."),
    (UNKNOWN, "This is not licensed under the MIT License."),
    (UNKNOWN, "The files are no longer released under the Apache License, Version 2.0, as of March."),
    (UNKNOWN, "It is never distributed under the GNU General Public License, version 3."),
    (UNKNOWN, "SPDX-License-Identifier: Zlib"),
    (UNKNOWN, "SPDX-License-Identifier: CC0-1.0"),
    (UNKNOWN, "SPDX-License-Identifier: CDDL-1.1"),
    (UNKNOWN, "SPDX-License-Identifier: OFL-1.1"),
    (UNKNOWN, "Boost Software License - Version 1.0 - August 17th, 2003"),
    (UNKNOWN, "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    (UNKNOWN, "CC BY-NC-ND 4.0"),
    (UNKNOWN, "The bus driver lost the license and the apache tribe kept version 2 of the story."),
    (UNKNOWN, "The MIT campus and its general public were free of charge."),
    (UNKNOWN, "She was granted permission to copy the software documentation."),
]


def found(spark, rows):
    got = {i: set() for i in range(len(rows))}
    for r in licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id int, text string")).collect():
        if r.family != UNKNOWN:
            got[r.doc_id].add(r.family)
    return got


def test_held_out_notices(spark):
    """Precision of 0.98 and recall of 0.9 by (notice, family); what is wrong is shown."""
    got = found(spark, [t for _, t in HELD_OUT])
    want = {i: {f} - {UNKNOWN} for i, (f, _) in enumerate(HELD_OUT)}
    wrong = [(HELD_OUT[i], got[i]) for i in want if got[i] != want[i]]
    right = sum(len(got[i] & want[i]) for i in want)
    named, there = sum(map(len, got.values())), sum(map(len, want.values()))
    assert len(HELD_OUT) >= 40 and right >= 0.98 * named and right >= 0.9 * there, wrong


def test_the_threshold_binds():
    """Held-out unknown texts that the likeliest class alone would name a licence, and the threshold does not."""
    weights, bias, threshold = licenses.model()
    import numpy as np

    called = stopped = 0
    for seed in range(40, 46):
        for grams, k in licenses.samples(seed):
            if k == 0:
                z = np.array(bias, float)
                for g in grams:
                    z += np.array(weights.get(g, [0] * len(bias)))
                p = np.exp((z - z.max()) / licenses.SCALE)
                p /= p.sum()
                called += p.argmax() > 0
                stopped += p.argmax() > 0 and p.max() < threshold
    assert threshold > 0.02 and stopped > 0 and stopped >= 0.2 * called
