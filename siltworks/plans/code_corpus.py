"""A code table made of ``part`` by one expression that Spark and DuckDB read alike."""

SQL = """SELECT p_partkey AS doc_id, p_brand AS repo, concat('f', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 5 = 0 THEN '.h' ELSE '.c' END) AS path, concat(
 CASE WHEN p_partkey % 7 <> 0 THEN concat('#include <x.h>', chr(10)) ELSE '' END,
 CASE WHEN p_partkey % 6 = 1 THEN concat('#define LIM(a) a+', CAST(p_size AS STRING), chr(10)) ELSE '' END,
 'static int f_', CAST(p_partkey % 97 AS STRING), '(int a) {{ /* ', p_name, ' */ if (a >= ', CAST(p_size AS STRING), ') return a; // ', p_type, chr(10),
 '  char *s = "', p_name, CASE WHEN p_partkey % 4 = 1 THEN ' // no /* no */' ELSE '' END, CASE WHEN p_partkey % 9 = 2 THEN concat(' ', chr(92), '"q', chr(92), '"') ELSE '' END, '";', chr(10),
 CASE WHEN p_partkey % 11 = 3 THEN concat('  strcpy(s, "', p_brand, '"); password = "', p_type, '";', chr(10)) ELSE '' END,
 CASE WHEN p_partkey % 13 = 4 THEN concat('  while (a < 3) {{ a += 1; eval(a + ', chr(39), 'c', chr(39), '); }}  x.y = 1.5f; ') ELSE '' END,
 '  int k = 0x1F;  return a ? 1 : 10L; }}', chr(10),
 CASE WHEN p_partkey % 10 = 5 THEN '/* open' ELSE '' END) AS text FROM {part}"""
