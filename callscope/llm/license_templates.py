"""Templates of licence texts and notices in matching markup; case, blanks and punctuation don't count.

``<<beginOptional>>``..``<<endOptional>>`` may be missing; ``<<var;words="lo,hi">>`` stands for lo to hi words of
any kind, ``<<var;any="x|y">>`` for one of the wordings listed. All other wording is mandatory.
"""

#: The public wording of licences, by label.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        """<<beginOptional>>MIT License<<endOptional>><<beginOptional>>Copyright <<var;words="0,20">><<endOptional>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;any="this software and associated documentation files (the "Software")|this software">>,
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;words="1,12">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        """<<var;any="licensed|released|distributed|available">> under <<beginOptional>>the terms of<<endOptional>> the MIT <<beginOptional>>open source<<endOptional>> license""",
    ),
    "isc": (
        """<<beginOptional>>ISC License<<endOptional>><<beginOptional>>Copyright <<var;words="0,20">><<endOptional>>
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words="1,8">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;words="1,8">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE
        OR PERFORMANCE OF THIS SOFTWARE.""",
        """<<var;any="licensed|released|distributed">> under the ISC license""",
    ),
    "bsd": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.
        <<beginOptional>><<beginOptional>>3<<endOptional>> Neither the name of <<var;words="1,12">> nor the names of its contributors may be used to endorse or promote products derived
        from this software without specific prior written permission.<<endOptional>>
        THIS SOFTWARE IS PROVIDED BY <<var;words="1,12">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;words="1,12">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY
        OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE.""",
        """<<var;any="licensed|released|distributed">> under <<beginOptional>>the terms of<<endOptional>> <<var;any="the|a">> <<var;any="BSD|new BSD|modified BSD|simplified BSD|BSD 2 clause|BSD 3 clause|2 clause BSD|3 clause BSD">> <<var;any="license|style license">>""",
    ),
    "apache-2": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        <<beginOptional>><<var;any="http|https">> www.apache.org/licenses/LICENSE-2.0<<endOptional>>
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        """<<var;any="licensed|released|distributed">> under <<beginOptional>>the terms of<<endOptional>> the Apache <<beginOptional>>software<<endOptional>> License<<beginOptional>>version<<endOptional>> 2<<beginOptional>>0<<endOptional>>""",
    ),
    "gpl-3": ("""GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>><<beginOptional>>either<<endOptional>><<var;any="version 3|v3">>""", """GPL <<var;any="version 3|v3|3">>"""),
    "gpl-2": ("""GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>><<beginOptional>>either<<endOptional>><<var;any="version 2|v2">>""", """GPL <<var;any="version 2|v2|2">>"""),
    "agpl-3": ("""GNU Affero General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>><<beginOptional>>either<<endOptional>><<var;any="version 3|v3">>""",),
    "lgpl": ("""GNU <<var;any="Lesser|Library">> General Public License""",),
    "mpl-2": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. <<beginOptional>>If a copy of the MPL was not distributed with this file, You can obtain one
        at <<var;words="1,8">><<endOptional>>""",
    ),
    "zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: <<beginOptional>>1<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
        product, an acknowledgment in the product documentation would be appreciated but is not required.
        <<beginOptional>>2<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        <<beginOptional>>3<<endOptional>> This notice may not be removed or altered from any source distribution.""",
    ),
    "unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
        code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
    "cc0-1": ("""<<beginOptional>>Creative Commons<<endOptional>> CC0 1.0 <<beginOptional>>Universal<<endOptional>>""",),
    "cc-by": ("""Creative Commons Attribution <<var;any="2 0|2 5|3 0|4 0">> <<beginOptional>><<var;any="International|Unported|Generic">><<endOptional>> License""",),
    "cc-by-sa": ("""Creative Commons Attribution ShareAlike <<var;any="2 0|2 5|3 0|4 0">>""", """CC BY SA <<var;any="2 0|2 5|3 0|4 0">>"""),
    "cc-by-nc": ("""Creative Commons Attribution NonCommercial <<var;any="2 0|2 5|3 0|4 0">>""", """CC BY NC <<var;any="2 0|2 5|3 0|4 0">>"""),
}
