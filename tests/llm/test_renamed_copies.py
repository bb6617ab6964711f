from corvex.llm import handwritten


def test_a_library_under_many_names(spark):
    lib = lambda k: "".join(f"int libfunc_{k}_{chr(97 + i)}(int value)\n{{\n    return helper_{k}_{chr(98 + i)}(value);\n}}\n" for i in range(20))
    rows = [(i, "github/o/r", f"third_party/l/lib{i}.c", lib("a") + f"int build_number_{i} = {i};\n") for i in range(8)]
    rows += [(100 + i, "gitlab/p/q", f"src/moved{i}.c", lib("a")) for i in range(5)]
    rows.append((200, "gitlab/p/q", "src/own.c", "".join(f"int mine_{i}(int other)\n{{\n    return {i} + yours_{i}(other);\n}}\n" for i in range(20))))
    rows.append((201, "gitlab/p/q", "src/part.c", lib("a")[:200] + rows[-1][3]))
    files = spark.createDataFrame(rows, "file_id long, index_name string, path string, content string")
    config = spark.createDataFrame([("github", ["c"]), ("gitlab", ["c"])], "provider string, index_extensions array<string>")
    got = {r.file_id: r.reason for r in handwritten.not_handwritten(files, config).collect()}
    assert got == {r[0]: "third_party" for r in rows if r[0] < 200}
