"""A small corpus of code that breaks rules, for queries whose rules prose does not touch."""

CORPUS = [
    ("a/run.sh", "#!/bin/bash\nset -e\nfoo || true\nmkdir x || true\ncleanup() {\n  rm x || true\n}\ntrap cleanup EXIT\nbar | baz 2>/dev/null # REASON: noise\necho ${HOME:-x}\nX=${Y:=z}\nls /home/me/x\n# /home/me/y\n"),
    ("a/install.sh", "#!/usr/bin/env bash\nset -euo pipefail\nfoo || :\n"),
    ("a/x.py", "import os\ndef f():\n    return 1\n    print(2)\ntry:\n    x = 1\nexcept Exception:\n    pass\npassword = 'hunter22'\ny = g(1)  # type: ignore\nz = 2  # noqa\nq = f\"select {x} from t\"\nsubprocess.run(a, shell=True)\nif __name__ == '__main__':\n    f()\n"),
    ("a/y.py", "import unittest\nfrom os import *\nG = []\ndef f(a=[]):\n    try:\n        r = requests.get('x')\n    except:\n        pass\n    except Exception as e:\n        logger.error('x')\n        raise ValueError('y')\n    raise 's'\n    open('f')\n    d.get('k')\n    getattr(x, 'y', None)\nif DEBUG:\n    f()\n"),
    ("a/test_z.py", "print(1)\nimport pytest\n@pytest.fixture\ndef f(): pass\n"),
    ("a/x.test.js", "beforeEach(() => {\n  server.listen(3)\n})\nbeforeAll(() => {\n  x();\n});\nit('x', () => { jest.fn() })\n"),
    ("a/y.js", "const unused = 1;\ntry { a() } catch (e) {}\napp.listen(3)\nconsole.log('x')\nfunction f() {\n  return 1;\n  foo();\n}\njest.mock('x')\nfetch('http://localhost:8080/a')\n// eslint-disable-next-line no-console\nimport x from './b.stories.js'\nconst q = `select * from t where a=${b}`\n"),
    ("a/s.js", "const app = express();\napp.get('/x', (req, res) => {\n  try {\n    fetch('http://a');\n  } catch (e) {\n  }\n  try { a() } catch (err) {\n    console.error(err);\n    res.json({});\n  }\n  fs.readFile('x', (err, data) => {\n    use(data);\n  });\n  p.catch(() => null);\n  Promise.reject('no');\n  eval('x');\n  throw new Error(\"failed\");\n});\n"),
    ("a/t.ts", "const x = y as any;\nz!.q;\n// @ts-ignore\nif (process.env.NODE_ENV === 'test') {}\nimport v from 'vitest'\na?.b?.c?.d?.e;\n"),
    ("a/m.cjs", "// c\nmodule.exports = 1\n"),
    ("a/.env", "SECRET=abcdefgh\nA=1\n"),
    ("b/.env", "A=1\n"),
    ("b/.gitignore", ".env\n"),
    ("c/conf.yaml", "path: /Users/me/x\npassword: swordfish\n"),
    ("r/lib.rs", "fn f() -> Result<(), Box<dyn Error>> {\n  unsafe { x }\n  // SAFETY: ok\n  unsafe { y }\n  z.unwrap();\n  eprintln!(\"x\");\n  let _ = g();\n  panic!(\"a\");\n  todo!();\n  h.expect(\"failed\");\n  std::process::exit(1);\n  #[allow(dead_code)]\n  fn k() {}\n}\n"),
    ("g/m.go", "package m\nimport \"github.com/stretchr/testify/mock\"\nfunc Do(w http.ResponseWriter, r *http.Request) {\n\tx, err := f()\n\tif err != nil {\n\t\tlog.Printf(\"x %v\", err)\n\t}\n\tw.WriteHeader(200)\n\tv, _ := g()\n\ty := v.(string)\n\tfor i := 0; i < n; i++ {\n\t\tdefer z.Close()\n\t}\n\tgo run(y)\n\tc := http.Client{}\n\tctx := context.TODO()\n\tcmd := exec.Command(\"sh\", \"-c\", a)\n\tos.Open(\"testdata/x\")\n}\nfunc A() (string, error) {\n\tif err := b(); err != nil {\n\t\treturn \"\", nil\n\t}\n\tif err != nil {\n\t\treturn nil\n\t}\n\tif err != nil {\n\t\treturn \"\", err\n\t}\n\tif err.Error() == \"x\" {\n\t}\n\treturn \"\", errors.New(\"failed\")\n}\n"),
    ("requirements.txt", "flask\nx==1\n# c\n-r other\nnumpy>=2\n"),
]


#: A unit of generated code by language: lines that break rules between lines that do not.
UNITS = {
    ".go": "func Load{k}(path string) (string, error) {\n\tdata, err := os.ReadFile(path)\n\tif err != nil {\n\t\treturn \"\", nil\n\t}\n\tname := string(data)\n\tfor i := 0; i < len(name); i++ {\n\t\tcount := i * 7\n\t\tlog.Printf(\"%d\", count)\n\t}\n\tif err := check(name); err != nil {\n\t\treturn \"\", err\n\t}\n\treturn name, nil\n}\n\n// Next is plain.\nfunc Next{k}(n int) int {\n\treturn n + 1\n}\n",
    ".js": "async function load{k}(url) {\n  const unused{k} = 1;\n  try {\n    const res = await fetch(url);\n    return await res.json();\n  } catch (e) {\n    console.error(e);\n  }\n  return null;\n}\n\n// plain\nexport function next{k}(n) {\n  if (n > 3) {\n    return n;\n  }\n  const total = n + 1;\n  console.log(total);\n  return total;\n}\n",
    ".py": "def load_{k}(path, seen=[]):\n    try:\n        with open(path) as f:\n            data = f.read()\n    except Exception:\n        pass\n    result = requests.get(path)\n    print(data)\n    return data\n\n\nclass Next{k}:\n    def step(self, n):\n        if n > 3:\n            return n\n        total = n + 1\n        return total\n\n# plain\nVALUE_{k} = {k}\n",
}


def generated(extension: str, lines: int = 10_000, per_file: int = 200) -> list[tuple[str, str]]:
    """Files of one language with about ``lines`` lines in all."""
    units = per_file // UNITS[extension].count("\n")
    body = lambda f: "".join(UNITS[extension].replace("{k}", str(f * units + k)) for k in range(units))
    return [(f"src/m{f}{extension}", body(f)) for f in range(lines // per_file)]
