"""Notices and clauses of common licences, by family, and lines that are none.

Fixed values: wordings of public licence notices.
"""

TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is licensed under the terms of the Apache 2.0 license.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU General Public License, version 2.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "Released under the Mozilla Public License 2.0.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "You may not use the material for commercial purposes under this Creative Commons NonCommercial licence.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This text is in the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) the authors. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This document is proprietary and confidential; unauthorized copying is strictly prohibited.",
    ],
}

NEITHER = [
    "The driver had to show a licence at the border.",
    "She was licensed to practise medicine in two states.",
    "A fishing license costs twenty dollars a year.",
    "The public library is open on Sundays and the park is free of charge.",
    "He reserved a table for two at the restaurant.",
    "All seats are reserved for members of the party.",
    "The general asked the public for permission to speak.",
    "Version 3 of the report was released under great pressure.",
    "The Apache helicopters were moved to another base.",
    "Students at MIT built a robot that can fold shirts.",
    "The commons voted on the bill after a long debate.",
    "Creative people often work at night.",
    "Copyright law is taught in the second year.",
    "The committee may obtain a copy of the minutes.",
    "Use of this road is restricted to residents.",
    "The rights of workers were discussed at length.",
    "The foundation gives money to free schools.",
    "Please read the terms and conditions of the sale.",
    "It was published in 1999 and distributed by mail.",
    "The software was slow and the authors were unhappy.",
]
