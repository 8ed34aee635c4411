"""License scans against the SQL that compares every block with every template."""

import duckdb
import pyarrow as pa

from ledgerline.llm import licenses

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def by_sql(rows):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    return sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({licenses.scan_sql()})").fetchall(), key=str)


TEXTS = [
    None, "", " \n\n ", "word", "CC BY", "cc-by\nCC\tBY cc by cc", "x all rights\nreserved", "ALL RIGHTS RESERVED. All rights reserved",
    "This work is licensed under the GNU General Public License, version 3.", "licensed under gnu public license version three",
    "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "released under the mit",
    "filler " * 500 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files" + " filler" * 300,
    "redistribution and use in source and binary forms with or without\nmodification are permitted provided that the following conditions are met",
    "the of a to is in and " * 2000, "licénse LİCENSE K mit", "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE VERSION 3", "this wor\u212a is licensed under the gnu", "general public license " * 300, "a\x00b\x7fc é9ñ z",
]


def test_blocks_and_phrases(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "CC BY"), (4, "CC BY"), (4, "mit license released under the")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, labels string, n_words int")
    got = sorted(map(tuple, licenses.scan(docs).select(COLUMNS).collect()), key=str)
    assert got == by_sql(rows)
    found = {r[0]: r for r in got}
    assert found[5][2:5] == (3, 0, 4) and found[6][5] == "reserved"
    assert "mit" in found[14][6] and "gpl-3.0" in found[8][6] and found[16][6] == "" and found[15][6] == "bsd"
    assert licenses.scan(docs.limit(0)).count() == 0


NEAR = {
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa-4.0", "licensed under CC BY 4.0": "cc-by,cc-by-4.0",
    "Sa maison est là. Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "Licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa-4.0", "Licensed under CC BY-NC-ND 4.0": "cc-by,cc-by-nc-nd-4.0",
    "Released under the Apache license": "", "the rules were released under license": "", "Released under the MIT License.": "mit", "Licensed under the MIT license": "mit",
    "This work is licensed under the GNU General Public License, version 2.": "gpl,gpl-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "licensed under the GNU Lesser General Public License": "gpl,lgpl", "licensed under the GNU Affero General Public License": "agpl,gpl", "All our rights are reserved": "", "All rights reserved": "reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files": "mit",
    "You may not use this file except in compliance with the\nLicense. You may obtain a copy of the\nLicense at": "apache-2.0",
    "Redistribution and use in source and binary forms, with or without modification,\nare permitted provided that the following conditions\nare met:": "bsd",
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License": "gpl",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.": "mpl-2.0", "licensed under the\nApache License,\nVersion 2.0": "apache-2.0",
    "This work is licensed under a Creative Commons Attribution 4.0\nInternational License": "cc-by-4.0", "Apache helicopters need no license version 2 0": "",
}


def test_labels_of_near_statements(spark):
    lead = ["", *(" ".join(f"w{i}" for i in range(n)) + "\n" for n in (1, 7, 11, 12, 13, 23, 24, 30, 47))]
    rows = [(i * 100 + k, a + t + "\nlast words", label) for i, (t, label) in enumerate(NEAR.items()) for k, a in enumerate(lead)]
    got = licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    assert {r.doc_id: r.labels for r in got.collect()} == {r[0]: r[2] for r in rows}


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, licenses.scan(docs).select(COLUMNS).collect()), key=str) == by_sql(rows)
