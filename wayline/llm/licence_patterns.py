"""Full texts, standard headers and usual phrases by which files state their licence, several a licence.

The full texts are files of ``licence_texts``, without their copyright lines. That of AGPL-3.0 is made of GPL-3.0
with its name and its section 13 replaced; the CC BY licences have headers and titles only.
"""

from __future__ import annotations

import re
from pathlib import Path

_TEXTS = Path(__file__).parent / "licence_texts"
_FORMS = (
    "{}", "The {}", "Licensed under the {}", "Distributed under the {}", "Released under the {}", "Available under the {}", "License: {}", "Under the terms of the {}",
    "This project is licensed under the {}", "This project is licensed under the {} - see the LICENSE file for details.",
    "This software is distributed under the {}, see the accompanying file LICENSE.", "This work is licensed under the {}. To view a copy of this license, visit",
)
#: License, a name of it, and the terms without which a phrase can't mean it.
_NAMES = (
    ("AGPL-3.0", "GNU Affero General Public License version 3", "affero 3"), ("AGPL-3.0", "GNU AGPLv3 license", "agplv3"),
    ("Apache-2.0", "Apache License, Version 2.0", "apache 2.0"), ("Apache-2.0", "Apache 2.0 license", "apache 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License", "bsd 2 clause"), ("BSD-2-Clause", "Simplified BSD License", "simplified bsd"),
    ("BSD-3-Clause", "BSD 3-Clause License", "bsd 3 clause"), ("BSD-3-Clause", "New BSD License", "new bsd"),
    ("BSL-1.0", "Boost Software License, Version 1.0", "boost 1.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License", "creative attribution 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License", "creative noncommercial 4.0"),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International Public License", "creative noncommercial noderivatives 4.0"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License", "creative noncommercial sharealike 4.0"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International Public License", "creative noderivatives 4.0"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License", "creative sharealike 4.0"),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication", "cc0"), ("CC0-1.0", "Creative Commons Zero license", "creative zero"),
    ("GPL-2.0", "GNU General Public License version 2", "general 2"), ("GPL-2.0", "GNU GPLv2 license", "gplv2"),
    ("GPL-3.0", "GNU General Public License version 3", "general 3"), ("GPL-3.0", "GNU GPLv3 license", "gplv3"),
    ("ISC", "ISC License", "isc"),
    ("LGPL-2.1", "GNU Lesser General Public License version 2.1", "lesser 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License version 3", "lesser 3"), ("LGPL-3.0", "GNU LGPLv3 license", "lgplv3"),
    ("MIT", "MIT License", "mit"),
    ("MPL-1.1", "Mozilla Public License, Version 1.1", "mozilla 1.1"), ("MPL-2.0", "Mozilla Public License, Version 2.0", "mozilla 2.0"),
    ("Unlicense", "Unlicense license", "unlicense"),
)
_GNU = (("AGPL-3.0", "Affero ", "3"), ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"))
_HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "apache"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', "apache"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "boost"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0"),
)


def _gnu(kind: str, version: str) -> tuple[str, str]:
    body = f"is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    rest = f"is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. You should have received a copy of the GNU {kind}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    return f"This program {body}", f"This program {body} This program {rest}"


def patterns() -> list[tuple[str, str, list[str]]]:
    """(license, text, terms that a unit must have)."""
    out = [(name, form.format(long), must.split()) for name, long, must in _NAMES for form in _FORMS]
    out += [(name, text, must.split()) for name, text, must in _HEADERS]
    for name, kind, version in _GNU:
        out += [(name, text, [*kind.lower().split(), "general", version]) for text in _gnu(kind, version)]
    for path in sorted(_TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out.append((path.stem, text, []))
        # The paragraph that grants the rights is often quoted alone.
        out += [(path.stem, p, []) for p in re.split(r"\n\s*\n", text) if len(text) < 2000 and re.match(r"\W*(Permission|This is free|Anyone)\b", p)]
    return out
