"""License notices get exactly their own label."""

from __future__ import annotations

import pytest

from tidemark.llm import licenses

MIT = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
GPL_2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
"""
NOTICES = {
    MIT: "mit",
    GPL_2: "gpl,gpl-2.0",
    GPL_2.replace("version 2", "version 3"): "gpl,gpl-3.0",
    GPL_2.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2", "version 2.1"): "gpl,lgpl-2.1",
    APACHE: "apache-2.0",
    BSD: "bsd",
    "Licensed under the Apache License, Version 2.0": "apache-2.0",
    "Released under the MIT License.": "mit",
    "Released under the GPL license": "gpl",
    "Licensed under the BSD 3-clause license": "bsd-3-clause",
    "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",
    "Licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "Licensed under the GNU Lesser General Public License, version 2.1": "gpl,lgpl-2.1",
    "Copyright 2020 A. Person. All rights reserved.": "copyright,reserved",
    "He was licensed under the version 2 of a license for the terms of trade.": "",
    "MIT \N{KELVIN SIGN} released under the LICENSE": "mit",
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}


@pytest.mark.parametrize("i", range(len(NOTICES)))
def test_each_notice_has_its_own_label(found, i):
    assert found[i]["labels"] == list(NOTICES.values())[i], list(NOTICES)[i]


def test_every_block_that_meets_a_template_is_counted(found):
    near = [i for i, v in enumerate(NOTICES.values()) if v == ""]
    assert all(found[i]["n_matches"] > 0 and found[i]["score"] == 0 for i in near)
    assert all(r["n_matches"] > 0 for r in found.values())
