"""Cases that an operator once left out."""

from structcheck.llm import licenses

DOCS = "doc_id long, text string"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def test_wrapped_license_texts_and_more_families(spark):
    wrapped = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell",
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
        "gpl": " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.",
        "agpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License.",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
        "zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.",
        "epl": "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at",
        "cc0": "To the extent possible under law, the author has waived all copyright and\nrelated rights to this work under CC0 1.0 Universal.",
        "unlicense": "This is free and unencumbered software released into the public domain.",
    }
    texts = [f"A story about a river.\n\n{w}\n\nThe end of it." for w in wrapped.values()] + ["The wine was released under the counter.\nHe had the license\nin the car."]
    out = {r["doc_id"]: {f["family"] for f in r["findings"] if f["confirmed"]} for r in licenses.scan(docs(spark, texts)).collect()}
    assert out == {i: {f} for i, f in enumerate(wrapped)} | {len(wrapped): set()}
