"""Wording of common licences and of the notices that name them.

A licence is cut where names, dates or list numbers vary. Each passage has the phrase that must stand in it whole.
"""

import re

#: (label, passage, phrase).
PASSAGES = (
    ("gpl", "This work is licensed under the GNU General Public License version 3", "general public license"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gnu general public license"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "see the gnu general public license"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program", "copy of the gnu general public license"),
    ("gpl", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "but changing it is not allowed"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "gnu lesser general public license"),
    ("lgpl", "You should have received a copy of the GNU Lesser General Public License along with this library", "copy of the gnu lesser general public license"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "gnu affero general public license"),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program", "copy of the gnu affero general public license"),
    ("mit", "Released under the MIT License", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "obtaining a copy of this software"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "to deal in the software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "this permission notice shall be included"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "with or without fee is hereby granted"),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy"),
    ("bsl-1.0", "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so", "prepare derivative works of the software"),
    ("zlib", "In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "to alter it and redistribute it freely"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "except in compliance with the license"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "software distributed under the license is distributed"),
    ("apache-2.0", "See the License for the specific language governing permissions and limitations under the License.", "specific language governing permissions"),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "apache license version 2 0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution and use"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "redistributions of source code must retain"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "redistributions in binary form must reproduce"),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission.", "endorse or promote products derived"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at", "if a copy of the mpl was not distributed"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "eclipse public license"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "free and unencumbered software"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "either in source code form or as a compiled binary"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.", "verbatim or modified copies of this license document"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons attribution sharealike"),
    ("reserved", "All rights reserved", "all rights reserved"),
)


def words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
