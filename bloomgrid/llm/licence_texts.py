"""Licence texts and standard file headers; of the longest licences the opening."""

#: (licence, text)
TEXTS = (
    ("agpl-3.0", (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "Affero General Public License for more details. You should have received a copy of the "
        "GNU Affero General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>."
    )),
    ("apache-2.0", (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        'to in writing, software distributed under the License is distributed on an "AS IS" '
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
        "License for the specific language governing permissions and limitations under the "
        "License."
    )),
    ("apache-2.0", (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND "
        'CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean '
        "the terms and conditions for use, reproduction, and distribution as defined by Sections "
        '1 through 9 of this document. "Licensor" shall mean the copyright owner or entity '
        'authorized by the copyright owner that is granting the License. "Legal Entity" shall '
        "mean the union of the acting entity and all other entities that control, are controlled "
        "by, or are under common control with that entity. For the purposes of this definition, "
        '"control" means (i) the power, direct or indirect, to cause the direction or management '
        "of such entity, whether by contract"
    )),
    ("bsd-2-clause", (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT "
        'HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT '
        "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE."
    )),
    ("bsd-3-clause", (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder "
        "nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED "
        'BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
        "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
        "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
        "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    )),
    ("bsl-1.0", (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a "
        "copy of the software and accompanying documentation covered by this license (the "
        '"Software") to use, reproduce, display, distribute, execute, and transmit the Software, '
        "and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following:"
    )),
    ("cc0-1.0", (
        "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW "
        "FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE "
        "AN ATTORNEY-CLIENT RELATIONSHIP. CREATIVE COMMONS PROVIDES THIS INFORMATION ON AN "
        '"AS-IS" BASIS. CREATIVE COMMONS MAKES NO WARRANTIES REGARDING THE USE OF THIS DOCUMENT '
        "OR THE INFORMATION OR WORKS PROVIDED HEREUNDER, AND DISCLAIMS LIABILITY FOR DAMAGES "
        "RESULTING FROM THE USE OF THIS DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER. "
        "Statement of Purpose The laws of most jurisdictions throughout the world automatically "
        "confer exclusive Copyright and Related Rights (defined below) upon the creator and "
        'subsequent owner(s) (each and all, an "owner") of an'
    )),
    ("gpl-2.0", (
        "This program is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details. You should have received a copy of the GNU "
        "General Public License along with this program; if not, write to the Free Software "
        "Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    )),
    ("gpl-2.0", (
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software "
        "Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is "
        "permitted to copy and distribute verbatim copies of this license document, but changing "
        "it is not allowed. Preamble The licenses for most software are designed to take away "
        "your freedom to share and change it. By contrast, the GNU General Public License is "
        "intended to guarantee your freedom to share and change free software--to make sure the "
        "software is free for all its users. This General Public License applies to most of the "
        "Free Software Foundation's software and to any other program whose"
    )),
    ("gpl-3.0", (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details. You should have received a copy of the GNU "
        "General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>."
    )),
    ("gpl-3.0", (
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software "
        "Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute "
        "verbatim copies of this license document, but changing it is not allowed. Preamble The "
        "GNU General Public License is a free, copyleft license for software and other kinds of "
        "works. The licenses for most software and other practical works are designed to take "
        "away your freedom to share and change the works. By contrast, the GNU General Public "
        "License is intended to guarantee your freedom to share and change all versions of a "
        "program--to make sure it remains free software for all its users. We, the"
    )),
    ("isc", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        'permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    )),
    ("lgpl-2.1", (
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version. This library "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU Lesser General Public License for more details. You should have received a copy "
        "of the GNU Lesser General Public License along with this library; if not, write to the "
        "Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 "
        "USA"
    )),
    ("lgpl-2.1", (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 "
        "Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 "
        "USA Everyone is permitted to copy and distribute verbatim copies of this license "
        "document, but changing it is not allowed. [This is the first released version of the "
        "Lesser GPL. It also counts as the successor of the GNU Library Public License, version "
        "2, hence the version number 2.1.] Preamble The licenses for most software are designed "
        "to take away your freedom to share and change it. By contrast, the GNU General Public "
        "Licenses are intended to guarantee your freedom to share and change free"
    )),
    ("lgpl-3.0", (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free "
        "Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and "
        "distribute verbatim copies of this license document, but changing it is not allowed. "
        "This version of the GNU Lesser General Public License incorporates the terms and "
        "conditions of version 3 of the GNU General Public License, supplemented by the "
        'additional permissions listed below. 0. Additional Definitions. As used herein, "this '
        'License" refers to version 3 of the GNU Lesser General Public License, and the "GNU GPL" '
        'refers to version 3 of the GNU General Public License. "The Library" refers to a covered '
        "work governed by this"
    )),
    ("mit", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in "
        'all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", '
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
        "NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    )),
    ("mpl-2.0", (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    )),
    ("mpl-2.0", (
        "Mozilla Public License Version 2.0 ================================== 1. Definitions "
        '-------------- 1.1. "Contributor" means each individual or legal entity that creates, '
        'contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" '
        "means the combination of the Contributions of others (if any) used by a Contributor and "
        'that particular Contributor\'s Contribution. 1.3. "Contribution" means Covered Software '
        'of a particular Contributor. 1.4. "Covered Software" means Source Code Form to which the '
        "initial Contributor has attached the notice in Exhibit A, the Executable Form of such "
        "Source Code Form, and Modifications of such Source Code Form, in each case including "
        'portions thereof. 1.5. "Incompatible With Secondary Licenses" means (a) that the initial '
        "Contributor"
    )),
    ("unlicense", (
        "This is free and unencumbered software released into the public domain. Anyone is free "
        "to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, "
        "and by any means."
    )),
    ("zlib", (
        "This software is provided 'as-is', without any express or implied warranty. In no event "
        "will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions:"
    )),
)
