"""Short notices and telling paragraphs of public licences by family, and sentences that only sound like them."""

TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "SPDX-License-Identifier: MIT",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "apache-2.0": (
        "SPDX-License-Identifier: Apache-2.0",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "gpl": (
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-3.0",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "agpl": (
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "bsd": (
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "mpl-2.0": (
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "cc-by": (
        "SPDX-License-Identifier: CC-BY-4.0",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "SPDX-License-Identifier: CC0-1.0",
        "Released under CC0 1.0 Universal, public domain dedication.",
        "To the extent possible under law, the authors have waived all copyright and related or neighboring rights to this work.",
    ),
    "isc": (
        "SPDX-License-Identifier: ISC",
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "unlicense": (
        "SPDX-License-Identifier: Unlicense",
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "proprietary": (
        "Copyright Example Corporation. All rights reserved.",
        "This document is confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
}

#: Words of licences: a paragraph with one and of no family counts as unknown.
TRIGGERS = r"(?i)\b(?:licen[cs]e[ds]?|copyright|permission|redistribut\w+|warrant\w+|gnu|apache|mozilla|creative commons|cc[ -]?by|cc0|unlicense|public domain|rights reserved|proprietary)\b"

UNKNOWN: tuple[str, ...] = (
    "She passed the test and got her driving license on the second attempt.",
    "The restaurant lost its liquor license after the inspection.",
    "He asked for permission to leave the room and the teacher agreed.",
    "A license to operate the crane must be renewed every year.",
    "The court issued a warrant for his arrest on Monday.",
    "The toaster comes with a two year warranty from the manufacturer.",
    "Apache helicopters were seen over the valley.",
    "The gnu is a large antelope that lives in Africa.",
    "Copyright law has changed a great deal since the first statute.",
    "A new version of the report was released under pressure from the public.",
    "Students need written permission from their parents.",
    "The general public was not admitted, and the work was hard.",
    "The software is under development and version 2.0 will follow in spring.",
    "The program was released under the old government.",
    "This work is based on earlier studies of the general population.",
    "The tax redistributes income and redistribution is debated in parliament.",
    "Mozilla released a new browser last week.",
    "The creative commons room in the library is open to all.",
    "The plumber is licensed and insured in the whole county.",
    "The pilot licensed under the old rules may fly until May.",
    "Doctors are licensed by the state board, version 3 of the form is required.",
    "The invention entered the public domain of knowledge long ago.",
    "Proprietary methods are used to roast the beans.",
    "The license plate was found in the river.",
    "All the permission slips were collected at the door.",
    "His poetic license was admired by the critics.",
    "The MIT campus lies along the river.",
    "Students at MIT released balloons under the dome.",
    "A fishing licence costs ten pounds for the season.",
    "The copyright page of the book was missing.",
    "No warranty covers damage by water.",
    "The county warrants the title of the land.",
)

#: Notices in other words than the templates', and sentences of no licence: only the calibration sees them.
CALIBRATION: dict[str, tuple[str, ...]] = {
    "mit": ("This project is available under the MIT license, see LICENSE.", "Code here is MIT licensed; permission is granted free of charge to any person obtaining a copy.", "Licensed under MIT."),
    "apache-2.0": ("Distributed under the Apache License 2.0.", "You may not use these files except in compliance with the Apache License, Version 2.0.", "Apache-2.0 licensed, on an as is basis without warranties or conditions of any kind."),
    "gpl": ("Released under the GNU GPL, version 3 or any later version.", "You can redistribute it under the terms of the GNU General Public License version 2.", "A copy of the GNU General Public License should come along with this program."),
    "lgpl": ("You may link to this library under the GNU Lesser General Public License.", "The library is free software under the GNU Lesser General Public License, version 3."),
    "agpl": ("This server is covered by the GNU Affero General Public License.", "Use is governed by the GNU Affero General Public License, version 3 or later."),
    "bsd": ("Redistribution in source and binary forms is permitted under the BSD license.", "Use of this source code is governed by a BSD-style license; redistribution and use in source and binary forms are permitted."),
    "mpl-2.0": ("Subject to the Mozilla Public License, version 2.0.", "The file is covered by the terms of the Mozilla Public License."),
    "cc-by": ("This text is under the Creative Commons Attribution 4.0 license.", "Available under CC BY 4.0."),
    "cc-by-sa": ("Text is available under the Creative Commons Attribution-ShareAlike 4.0 license.", "Shared under CC BY-SA 4.0."),
    "cc-by-nc": ("Pictures are under a Creative Commons Attribution-NonCommercial 4.0 license.", "Shared under CC BY-NC 4.0."),
    "cc0": ("Dedicated to the public domain under CC0 1.0.", "The authors waived all copyright and related rights to this work under CC0."),
    "isc": ("ISC License applies.", "Permission to use, copy, modify and distribute this software for any purpose is granted without fee."),
    "unlicense": ("This is unencumbered software in the public domain.", "Free and unencumbered software under the Unlicense."),
    "proprietary": ("All rights reserved by Example Corporation.", "Confidential and proprietary: unauthorized copying of this document is prohibited."),
}
CALIBRATION_UNKNOWN: tuple[str, ...] = (
    "She renewed her license to teach in the spring.",
    "With the permission of the owner they camped by the lake.",
    "The copyright of the song was sold to a film company.",
    "A warranty of five years covers the roof.",
    "The gnu herd crossed the river at dawn.",
    "The apache pilots trained for months.",
    "Her licence was suspended after the accident.",
    "The museum holds works in the public domain since the old law ended.",
    "The creative commons of the village was fenced in.",
    "Wealth was redistributed by the new tax.",
    "A proprietary recipe is kept in the safe.",
    "Software of this kind needs a lot of memory and the work takes long.",
    "They distributed copies of the program at the door of the theatre.",
    "The general terms and conditions hung on the wall.",
)
