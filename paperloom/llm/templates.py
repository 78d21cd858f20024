"""Licence templates. Optional regions stand between `<<beginOptional>>` and `<<endOptional>>`; replaceable ones are
`<<var;match=...;most=n>>`, up to n words that each match. `<<o>>` and `<</o>>` are short for the optional marks."""

from __future__ import annotations

#: One-line notices, by label.
NOTICES = {
    "gpl-notice": "<<o>>this<</o>> <<var;match=[a-z]+;most=3>> licensed under <<o>>the terms of<</o>> the gnu <<o>>lesser<</o>> general public license <<o>>as published by the free software foundation<</o>> <<o>>either<</o>> version <<var;match=[0-9]+;most=2>> <<o>>of the license or at your option any later version<</o>>",
    "apache-notice": "licensed under the apache license <<o>>version<</o>> <<var;match=[0-9]+;most=2>> <<o>>the license you may not use this file except in compliance with the license<</o>>",
    "cc-by-notice": "licensed under <<o>>a<</o>> <<o>>creative commons<</o>> <<o>>cc<</o>> <<o>>attribution<</o>> by <<o>>nc<</o>> <<o>>sa<</o>> <<o>>nd<</o>> <<var;match=[0-9]+;most=2>> <<o>>international<</o>> <<o>>license<</o>>",
    "mit-notice": "<<o>>released<</o>> <<o>>licensed<</o>> <<o>>distributed<</o>> under the <<o>>terms of the<</o>> mit license",
    "spdx-tag": "spdx license identifier <<var;match=[0-9a-z]+;most=4>>",
    "rights-reserved": "copyright <<o>>c<</o>> <<var;match=.+;most=8>> all rights reserved",
}
#: Whole licences and file headers, by label, in their authors' words.
LICENCES = {
    "mit-text": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        <<o>>(the "Software")<</o>>, to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
        do so, subject to the following conditions: The above copyright notice and this permission notice <<o>>(including the next
        paragraph)<</o>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;match=.+;most=8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
        AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE""",
    "bsd-text": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: <<o>>1<</o>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. <<o>>2<</o>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. <<o>><<o>>3<</o>> Neither the name of
        <<var;match=.+;most=8>> nor the names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission.<</o>> THIS SOFTWARE IS PROVIDED BY <<var;match=.+;most=8>> "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL <<var;match=.+;most=8>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
        CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE""",
    "isc-text": """
        Permission to use, copy, modify, and<<o>>/or<</o>> distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        <<var;match=.+;most=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL <<var;match=.+;most=8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
        OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE""",
    "zlib-text": """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: <<o>>1<</o>> The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required. <<o>>2<</o>> Altered source versions must be
        plainly marked as such, and must not be misrepresented as being the original software. <<o>>3<</o>> This notice may not be removed or
        altered from any source distribution""",
    "apache-header": """
        Licensed under the Apache License, Version 2.0 <<o>>(the "License")<</o>>; you may not use this file except in compliance with the
        License. You may obtain a copy of the License at <<o>>http<</o>><<o>>https<</o>> www apache org licenses LICENSE 2 0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
        OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
        under the License""",
    "gpl-header": """
        is free software<<o>>;<</o>> you can redistribute it and/or modify it under the terms of the GNU
        <<o>>Lesser<</o>><<o>>Affero<</o>> General Public License as published by the Free Software Foundation<<o>>, either<</o>> version
        <<var;match=[0-9]+;most=2>> <<o>>of the License<</o>><<o>>, or (at your option) any later version<</o>>. <<var;match=.+;most=4>> is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU <<o>>Lesser<</o>><<o>>Affero<</o>> General Public License for more details""",
}
TEMPLATES = {
    label: text.replace("<<o>>", "<<beginOptional>>").replace("<</o>>", "<<endOptional>>") for label, text in {**NOTICES, **LICENCES}.items()
}
