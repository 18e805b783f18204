"""Each rule fires on its licence's own wording, in the query and in SQL."""

from pathlib import Path

import pytest

from spanloom.llm import licenses
from tests.oracle import check

WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.'
MIT = f"""MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

{WARRANTY}
"""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
TEXTS = [
    (MIT, "MIT", "permissive"),
    (BSD2, "BSD-2-Clause", "permissive"),
    (BSD2 + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n", "BSD-3-Clause", "permissive"),
    ('Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT', "ISC", "permissive"),
    ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy', "Apache-2.0", "permissive"),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful. See the\nGNU General Public License for more details.\n", "GPL-3.0-or-later", "copyleft"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file", "MPL-2.0", "copyleft"),
    ("Released under the MIT License.", "MIT", "permissive"),
    ("Licensed under the MIT License.", "MIT", "permissive"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0", "permissive"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only", "copyleft"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0", "permissive"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0", "copyleft"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", "noncommercial"),
    ("Copyright 2020 Someone. All rights reserved.", "Proprietary", "proprietary"),
    (WARRANTY, "", "none"),
    ("Copyright (c) 1990, The Regents.\nAll rights reserved.\n\n" + BSD2 + "\n3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n", "BSD-3-Clause", "permissive"),
    ("Copyright 2008, Some Inc. All rights reserved.\n\n" + BSD2 + "\n   * Neither the name of Some Inc. nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.\n", "BSD-3-Clause", "permissive"),
    ("# Title\n\nThis project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.\n", "MIT", "permissive"),
    ("Code is licensed under the Apache License 2.0.", "Apache-2.0", "permissive"),
    ("Distributed under the terms of the GNU General Public License v3.0.", "GPL-3.0-only", "copyleft"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later\n#include <x.h>\n", "GPL-2.0-or-later", "copyleft"),
    ("/* SPDX-License-Identifier: MIT */\nint x;", "MIT", "permissive"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n", "Apache-2.0", "permissive"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n", "GPL-3.0-only", "copyleft"),
    ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n", "MPL-2.0", "copyleft"),
    ("The sea under the ice. Materials and contributors were many.", "", "none"),
    (BSD2 + "\n3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\n   This product includes software.\n\n4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n", "BSD-4-Clause", "permissive"),
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful. See the\nGNU General Public License for more details.\n", "GPL-2.0-or-later", "copyleft"),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful.  See the GNU\nLesser General Public License for more details.\n", "LGPL-2.1-or-later", "copyleft"),
    (" * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU Affero General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * See the\n * GNU Affero General Public License for more details.\n", "AGPL-3.0-or-later", "copyleft"),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin", "Zlib", "permissive"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.\n", "Unlicense", "permissive"),
    ('Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the "Software") to use, reproduce, display, distribute,\nexecute, and transmit the Software, and to prepare derivative works of the\nSoftware, and to permit third-parties to whom the Software is furnished to\ndo so, all subject to the following:\n\nThe copyright notices', "BSL-1.0", "permissive"),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/\n\nSPDX", "EPL-2.0", "copyleft"),
    ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software", "CC0-1.0", "permissive"),
    ("This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself.", "Artistic-1.0-Perl OR GPL-1.0-or-later", "copyleft"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("licences"))
    spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TEXTS)], "doc_id long, text string").coalesce(1).write.parquet(f"{path}/parts")
    next(Path(path, "parts").glob("*.parquet")).rename(f"{path}/documents.parquet")
    return path


def test_real_texts(spark, folder):
    got = {r["doc_id"]: (r["licenses"], r["kind"]) for r in licenses.scan(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [(n, k) for _, n, k in TEXTS]


def test_real_texts_by_sql(spark, folder):
    check(spark, lambda s, d: licenses.scan(s.read.parquet(f"{d}/documents.parquet")), licenses.oracle_sql(), folder)
