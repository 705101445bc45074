"""Fixed values of the licence classifier: paragraphs of well-known licences, notices made by rule, and prose that only sounds like them."""

# fixed values: paragraphs of public licence texts and of the notices that they ask for, by family
PARAGRAPHS = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
        "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
        "\"Contribution\" shall mean any work of authorship, including the original version of the Work and any modifications or additions to that Work or Derivative Works thereof, that is intentionally submitted to Licensor for inclusion in the Work by the copyright owner.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work.",
        "You must cause any modified files to carry prominent notices stating that You changed the files; and You must retain, in the Source form of any Derivative Works that You distribute, all copyright, patent, trademark, and attribution notices from the Source form of the Work.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "\"Contributor\" shall mean Licensor and any individual or Legal Entity on behalf of whom a Contribution has been received by Licensor and subsequently incorporated within the Work.",
        "\"Work\" shall mean the work of authorship, whether in Source or Object form, made available under the License, as indicated by a copyright notice that is included in or attached to the work.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "This software is provided by the regents and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the regents or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption).",
        "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice; keep intact all notices stating that this License and any non-permissive terms added in accord with section 7 apply to the code.",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software.",
        "You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty; keep intact all the notices that refer to this License and to the absence of any warranty; and give any other recipients of the Program a copy of this License along with the Program.",
        "You may convey a work based on the Program, or the modifications to produce it from the Program, in the form of source code under the terms of section 4, provided that you also meet all of these conditions.",
        "You may charge any price or no price for each copy that you convey, and you may offer support or warranty protection for a fee.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
        "The object code form of an Application may incorporate material from a header file that is part of the Library.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
        "If you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
        "\"Covered Software\" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof.",
        "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "The accompanying program is provided under the terms of this Eclipse Public License. Any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement.",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
    ],
    "eupl": [
        "Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence.",
        "This European Union Public Licence (the EUPL) applies to the Work which is provided under the terms of this Licence. Any use of the Work, other than as authorised under this Licence is prohibited.",
        "You may obtain a copy of the Licence at https://joinup.ec.europa.eu/software/page/eupl",
    ],
    "bsl-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software.",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, unless such copies are solely in the form of machine-executable object code generated by a source language processor.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.",
        "This is an open access article distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/.",
        "This article is distributed under the terms of the Creative Commons Attribution Non Commercial License, which permits non-commercial use, reproduction and distribution of the work without further permission.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0 1.0 Universal. This work is distributed without any warranty.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
    ],
    "wtfpl": [
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
        "This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar.",
        "Do what the fuck you want to public license, terms and conditions for copying, distribution and modification: you just do what the fuck you want to.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) 2020 Example Inc. All rights reserved.",
        "This software is proprietary and confidential; unauthorized copying of this file, via any medium, is strictly prohibited.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "You may not copy, modify, distribute, sell, or lease any part of our services or included software, nor may you reverse engineer or attempt to extract the source code of that software.",
    ],
}

# fixed values: names of the families in notices, and their identifiers
NAMES = {
    "mit": (["the MIT License", "the MIT licence", "an MIT-style license"], ["MIT"]),
    "isc": (["the ISC License", "the ISC licence"], ["ISC"]),
    "apache-2.0": (["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache-2.0 license"], ["Apache-2.0", "Apache 2.0"]),
    "bsd": (["the BSD 3-Clause License", "the BSD 2-Clause License", "the BSD license", "a BSD-style license"], ["BSD-3-Clause", "BSD-2-Clause"]),
    "gpl": (["the GNU General Public License, version 3", "the GNU General Public License, version 2", "the GPL, version 2 or later", "GPLv2", "GPLv3"], ["GPL-3.0", "GPL v2", "GPL v3", "GPL-2.0-or-later"]),
    "lgpl": (["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License", "the LGPL, version 3", "LGPLv2.1", "LGPLv3"], ["LGPL-2.1", "LGPL-3.0"]),
    "agpl": (["the GNU Affero General Public License, version 3", "the AGPL, version 3", "AGPLv3"], ["AGPL-3.0", "AGPL v3"]),
    "mpl-2.0": (["the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0", "the MPL 2.0"], ["MPL-2.0"]),
    "epl": (["the Eclipse Public License 2.0", "the Eclipse Public License v1.0", "the EPL 2.0"], ["EPL-2.0", "EPL-1.0"]),
    "eupl": (["the European Union Public Licence", "the EUPL, version 1.2", "the EUPL 1.2"], ["EUPL-1.2"]),
    "bsl-1.0": (["the Boost Software License, Version 1.0", "the Boost Software License"], ["BSL-1.0"]),
    "zlib": (["the zlib License", "the zlib/libpng License"], ["Zlib"]),
    "cc-by": (["CC BY 4.0", "a Creative Commons Attribution license", "the Creative Commons Attribution 4.0 International License"], ["CC-BY-4.0", "CC BY 3.0"]),
    "cc-by-nc": (["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial license", "the Creative Commons Attribution-NonCommercial 4.0 International License"], ["CC-BY-NC-4.0", "CC BY-NC 3.0"]),
    "cc-by-sa": (["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike license", "the Creative Commons Attribution-ShareAlike 4.0 International License"], ["CC-BY-SA-4.0", "CC BY-SA 3.0"]),
    "public-domain": (["CC0 1.0 Universal", "the Unlicense", "a public domain dedication"], ["CC0-1.0", "Unlicense"]),
    "wtfpl": (["the WTFPL", "the Do What The Fuck You Want To Public License"], ["WTFPL"]),
    "proprietary": (["a proprietary license", "a commercial license"], ["Proprietary"]),
}

# fixed values: notices around a name, and around an identifier
NOTICES = [
    "Released under {}.", "Licensed under {}.", "This project is licensed under the terms of {}.", "Distributed under {}.", "This software is made available under {}.",
    "Published under {}.", "This work is licensed under {}.", "This library is licensed under {}.", "The code is under {}.", "See {} for more details.", "Subject to the terms of {}.", "Dual licensed, at your option, under {}.",
]
SHORT = ["License: {}", "SPDX-License-Identifier: {}", "{} licensed", "license {}", "{} license", "licence = \"{}\""]

# fixed values: sentences with the words of licences, but of no family
OTHER = [
    "You need a driving licence to rent a car in this country.",
    "The restaurant lost its liquor license after the inspection.",
    "Permission is needed from the landlord before you paint the walls.",
    "Her general permission to use the garden was free of charge.",
    "The warranty of the washing machine covers two years of use.",
    "The copyright of the song was the subject of a long trial.",
    "He was licensed as a pilot under the old rules.",
    "The public library is open to any person without restriction.",
    "The software was released last year and is still free to use.",
    "A copy of the letter was included with the documents.",
    "The rights of the tenants were reserved for a later debate.",
    "Fishing licences are sold at the village shop in version A and B.",
    "The foundation published the terms of the prize in the paper.",
    "Wir fahren mit dem Zug und mit den Kindern an die See.",
    "Er sprach mit ihr, mit uns und mit allen Leuten im Dorf.",
    "The common name of the plant is not a public matter.",
    "We met the mayor of the licence office in the town hall by the river.",
    "The apache helicopter landed near the mozilla of the old zoo.",
    "An eclipse of the sun is visible in the union of the two states.",
    "Licensed premises have to close at eleven in this town.",
    "The doctor is licensed to practise in three states.",
    "The committee attributed the loss to a boost in prices.",
    "Students of the institute read about the general and the public of his time.",
    "The film was released under a new title in the north of the country.",
    "The author of the letter shall not be named in this report.",
    "The creative people of the commons met for the reading of poems.",
    "In the event of rain the game is played on the other field.",
    "The materials were provided by the town and distributed by hand.",
    "Any person may use the path in so far as the gate is open.",
    "The company sells a product for commercial use in kitchens.",
    "The terms of the peace were published and read to the public.",
    "His version of the story was subject to change.",
]
