"""Rows that queries over the small repository must give, worked out by hand from its files: columns with SQL types, rows."""

from __future__ import annotations

ROWS: dict[str, tuple[str, list]] = {
    "exports_table": (
        "path VARCHAR, name VARCHAR, kind VARCHAR, is_default BOOLEAN",
        [
            ('app/(shop)/items/[id]/page.tsx', 'Page', 'component', True),
            ('app/api/items/route.ts', 'GET', 'component', False),
            ('cmd/main.go', 'Start', 'function', False),
            ('core/lib.rs', 'Point', 'function', False),
            ('core/lib.rs', 'Shape', 'function', False),
            ('core/lib.rs', 'area', 'function', False),
            ('server/main.py', 'Service', 'class', False),
            ('server/main.py', 'items', 'function', False),
            ('server/main.py', 'start', 'function', False),
            ('server/models.py', 'User', 'class', False),
            ('src/app.tsx', 'App', 'component', True),
            ('src/app.tsx', 'Level', 'enum', False),
            ('src/app.tsx', 'Mode', 'type', False),
            ('src/app.tsx', 'Props', 'interface', False),
            ('src/app.tsx', 'helper', 'variable', False),
            ('src/components/Button.tsx', 'Button', 'component', False),
            ('src/lib/api.ts', 'Client', 'class', False),
            ('src/lib/api.ts', 'fetchItem', 'function', False),
            ('src/util/index.ts', 'count', 'variable', False),
        ],
    ),
    "types_table": (
        "path VARCHAR, name VARCHAR, kind VARCHAR, properties VARCHAR, extends VARCHAR",
        [
            ('cmd/main.go', 'Server', 'interface', 'Name string|Port int', ''),
            ('core/lib.rs', 'Point', 'interface', 'x: i32|y: i32', ''),
            ('core/lib.rs', 'Shape', 'enum', 'Circle|Square', ''),
            ('src/app.tsx', 'Level', 'enum', 'Low|High', ''),
            ('src/app.tsx', 'Mode', 'type', "'dark'|'light'", ''),
            ('src/app.tsx', 'Props', 'interface', 'title: string|count?: number', 'Base|Named'),
        ],
    ),
    "types_top": (
        "path VARCHAR, name VARCHAR, kind VARCHAR",
        [
            ('cmd/main.go', 'Server', 'interface'),
            ('core/lib.rs', 'Point', 'interface'),
            ('src/app.tsx', 'Props', 'interface'),
        ],
    ),
    "classes_table": (
        "path VARCHAR, name VARCHAR, base VARCHAR, interfaces VARCHAR, is_abstract BOOLEAN",
        [
            ('server/main.py', 'Service', 'Base', '', False),
            ('server/models.py', 'User', None, '', False),
            ('src/lib/api.ts', 'Client', 'Base', 'Closable', False),
        ],
    ),
    "component_uses": (
        "src VARCHAR, dst VARCHAR, component VARCHAR",
        [
            ('app/(shop)/items/[id]/page.tsx', 'src/app.tsx', 'App'),
            ('src/app.tsx', 'src/components/Button.tsx', 'Button'),
        ],
    ),
    "import_specifiers": (
        "path VARCHAR, source VARCHAR, names VARCHAR, is_default BOOLEAN",
        [
            ('server/main.py', '.models', 'User|Group', False),
            ('server/main.py', 'flask', 'Flask', False),
            ('server/main.py', 'os', 'os', False),
            ('server/main.py', 'sys', 'sys', False),
            ('src/app.test.ts', './app', 'helper', False),
            ('src/app.tsx', './lib/api', 'api|Options', False),
            ('src/app.tsx', './util', '*', False),
            ('src/app.tsx', '@/components/Button', 'Button', True),
            ('src/app.tsx', 'react', 'React|useState', True),
            ('src/components/Button.tsx', 'react', 'React', True),
            ('src/lib/api.ts', '../app', 'helper', False),
            ('src/lib/api.ts', 'axios', 'axios', True),
        ],
    ),
    "framework_order": (
        "repo VARCHAR, framework VARCHAR",
        [
            ('a', 'Django'),
            ('b', 'Vue'),
            ('c', 'Rust/Cargo'),
            ('d', None),
            ('e', 'SvelteKit'),
            ('f', 'Next.js'),
        ],
    ),
    "structural_index": (
        "path VARCHAR, language VARCHAR, line_count INT, exports VARCHAR, imports VARCHAR, signatures VARCHAR",
        [
            ('README.md', 'markdown', 2, '', '', ''),
            ('app/(shop)/items/[id]/page.tsx', 'typescript', 2, 'Page', '', 'export default function Page()'),
            ('app/api/items/route.ts', 'typescript', 2, 'GET', '', 'export async function GET(req)'),
            ('cmd/main.go', 'go', 18, 'Start', '', 'func (s *Server) Start(port int)|func main()'),
            ('core/lib.rs', 'rust', 7, 'Point|Shape|...(1 more)', '', 'pub fn area(p: Point) -> i32'),
            ('package.json', 'json', 1, '', '', ''),
            ('server/main.py', 'python', 22, 'Service|items|...(1 more)', '.models|flask|os', 'def run(self)|def _stop(self)|def start(port: int) -> None|def items()'),
            ('server/models.py', 'python', 3, 'User', '', ''),
            ('skills/review.md', 'markdown', 7, '', '', ''),
            ('src/app.test.ts', 'typescript', 2, '', './app', ''),
            ('src/app.tsx', 'typescript', 15, 'App|Level|...(3 more)', './lib/api|./util|@/components/Button', 'export default function App()'),
            ('src/components/Button.tsx', 'typescript', 4, 'Button', 'react', ''),
            ('src/lib/api.ts', 'typescript', 22, 'Client|fetchItem', '../app|axios', 'export async function fetchItem(id: string, retries = 3): Promise<Item>|function hidden()'),
            ('src/util/index.ts', 'typescript', 5, 'count', '', ''),
        ],
    ),
    "structural_index_trimmed": (
        "path VARCHAR, no_signatures BOOLEAN, no_imports BOOLEAN, no_exports BOOLEAN",
        [
            ('README.md', False, False, False),
            ('app/(shop)/items/[id]/page.tsx', True, False, True),
            ('app/api/items/route.ts', True, False, True),
            ('cmd/main.go', True, False, True),
            ('core/lib.rs', True, False, True),
            ('package.json', False, False, False),
            ('server/main.py', True, True, True),
            ('server/models.py', False, False, True),
            ('skills/review.md', False, False, False),
            ('src/app.test.ts', False, True, False),
            ('src/app.tsx', True, True, False),
            ('src/components/Button.tsx', False, True, True),
            ('src/lib/api.ts', True, True, True),
            ('src/util/index.ts', False, False, True),
        ],
    ),
    "file_routes": (
        "path VARCHAR, route VARCHAR, kind VARCHAR",
        [
            ('app/(shop)/items/[id]/page.tsx', '/items/:id', 'page'),
            ('app/api/items/route.ts', '/api/items', 'api'),
            ('pages/api/hello.ts', '/api/hello', 'api'),
            ('pages/blog/[...slug].vue', '/blog/:slug*', 'page'),
            ('pages/index.tsx', '/', 'page'),
            ('src/app/@modal/(auth)/login/page.jsx', '/login', 'page'),
        ],
    ),
    "web_routes": (
        "path VARCHAR, method VARCHAR, route VARCHAR",
        [
            ('a.js', 'GET', '/x'),
            ('a.js', 'POST', '/y/:id'),
            ('server/main.py', 'GET', '/items'),
        ],
    ),
    "symbol_tree": (
        "path VARCHAR, line_no INT, end_line INT, kind VARCHAR, name VARCHAR, parent VARCHAR",
        [
            ('app/(shop)/items/[id]/page.tsx', 1, 2, 'function', 'Page', None),
            ('app/api/items/route.ts', 1, 2, 'function', 'GET', None),
            ('server/main.py', 11, 13, 'function', '_stop', 'Service'),
            ('server/main.py', 14, 19, 'function', 'start', None),
            ('server/main.py', 20, 22, 'function', 'items', None),
            ('server/main.py', 7, 13, 'class', 'Service', None),
            ('server/main.py', 8, 10, 'function', 'run', 'Service'),
            ('server/models.py', 1, 3, 'class', 'User', None),
            ('src/app.tsx', 11, 15, 'function', 'App', None),
            ('src/lib/api.ts', 10, 18, 'class', 'Client', None),
            ('src/lib/api.ts', 12, 14, 'method', 'close', 'Client'),
            ('src/lib/api.ts', 15, 18, 'method', 'open', 'Client'),
            ('src/lib/api.ts', 19, 22, 'function', 'hidden', None),
            ('src/lib/api.ts', 7, 9, 'function', 'fetchItem', None),
        ],
    ),
    "symbol_ranges": (
        "path VARCHAR, line_no INT, end_line INT, kind VARCHAR, name VARCHAR, exported BOOLEAN",
        [
            ('app/(shop)/items/[id]/page.tsx', 1, 2, 'function', 'Page', True),
            ('app/api/items/route.ts', 1, 2, 'function', 'GET', True),
            ('cmd/main.go', 13, 16, 'function', 'Start', True),
            ('cmd/main.go', 17, 18, 'function', 'main', False),
            ('cmd/main.go', 8, 12, 'type', 'Server', True),
            ('core/lib.rs', 2, 2, 'struct', 'Point', True),
            ('core/lib.rs', 3, 3, 'enum', 'Shape', True),
            ('core/lib.rs', 4, 7, 'function', 'area', True),
            ('server/main.py', 11, 13, 'function', '_stop', False),
            ('server/main.py', 14, 19, 'function', 'start', True),
            ('server/main.py', 20, 22, 'function', 'items', True),
            ('server/main.py', 7, 7, 'class', 'Service', True),
            ('server/main.py', 8, 10, 'function', 'run', True),
            ('server/models.py', 1, 3, 'class', 'User', True),
            ('src/app.tsx', 10, 10, 'enum', 'Level', True),
            ('src/app.tsx', 11, 13, 'function', 'App', True),
            ('src/app.tsx', 14, 15, 'function', 'helper', True),
            ('src/app.tsx', 5, 8, 'interface', 'Props', True),
            ('src/app.tsx', 9, 9, 'type', 'Mode', True),
            ('src/components/Button.tsx', 2, 4, 'function', 'Button', True),
            ('src/lib/api.ts', 10, 18, 'class', 'Client', True),
            ('src/lib/api.ts', 19, 22, 'function', 'hidden', False),
            ('src/lib/api.ts', 7, 9, 'function', 'fetchItem', True),
        ],
    ),
    "typed_functions": (
        "path VARCHAR, name VARCHAR, summary VARCHAR, params VARCHAR, returns VARCHAR",
        [
            ('src/lib/api.ts', 'fetchItem', 'Fetches one item.', 'id:string|retries:?', 'Promise<Item>'),
        ],
    ),
    "code_outline": (
        "path VARCHAR, outline VARCHAR",
        [
            ('cmd/main.go', 'cmd/main.go (18 lines)\nexports: Start\nfunctions: func (s *Server) Start(port int), func main()'),
            ('src/lib/api.ts', 'src/lib/api.ts (22 lines)\nimports: ../app, axios\nexports: Client, fetchItem\nfunctions: export async function fetchItem(id: string, retries = 3): Promise<Item>, function hidden()'),
        ],
    ),
    "language_maps": (
        "path VARCHAR, parsed VARCHAR, listed VARCHAR, indexed VARCHAR, scanned VARCHAR",
        [
            ('Dockerfile', None, 'dockerfile', None, None),
            ('a.mts', 'typescript', None, None, None),
            ('b.tsx', 'typescript', 'typescript', 'tsx', 'JavaScript/TypeScript'),
            ('c.vue', 'typescript', 'vue', None, None),
            ('d.kts', 'kotlin', None, None, 'Kotlin'),
            ('e.txt', None, None, None, None),
            ('f.YML', None, 'yaml', 'yaml', None),
        ],
    ),
    "import_sources": (
        "path VARCHAR, source VARCHAR, external BOOLEAN",
        [
            ('cmd/main.go', 'fmt', True),
            ('cmd/main.go', 'net/http', True),
            ('core/lib.rs', 'crate::models', False),
            ('server/main.py', '.models', False),
            ('server/main.py', 'flask', True),
            ('server/main.py', 'os', True),
            ('server/main.py', 'sys', True),
            ('src/app.test.ts', './app', False),
            ('src/app.tsx', './lib/api', False),
            ('src/app.tsx', './util', False),
            ('src/app.tsx', '@/components/Button', False),
            ('src/app.tsx', 'react', True),
            ('src/components/Button.tsx', 'react', True),
            ('src/lib/api.ts', '../app', False),
            ('src/lib/api.ts', 'axios', True),
        ],
    ),
    "import_edges": (
        "src VARCHAR, dst VARCHAR",
        [
            ('server/main.py', 'server/models.py'),
            ('src/app.test.ts', 'src/app.tsx'),
            ('src/app.tsx', 'src/components/Button.tsx'),
            ('src/app.tsx', 'src/lib/api.ts'),
            ('src/app.tsx', 'src/util/index.ts'),
            ('src/lib/api.ts', 'src/app.tsx'),
        ],
    ),
    "line_kinds": (
        "path VARCHAR, line_no INT, is_comment BOOLEAN, is_string BOOLEAN, is_type BOOLEAN, is_test BOOLEAN, is_generated BOOLEAN, is_example BOOLEAN, sanitized BOOLEAN, near BOOLEAN",
        [
            ('docs/examples/b.py', 1, True, False, False, False, False, True, False, False),
            ('docs/examples/b.py', 2, True, False, False, False, False, True, False, False),
            ('docs/examples/b.py', 3, False, False, False, False, False, True, False, False),
            ('docs/examples/b.py', 4, False, False, False, False, False, True, False, False),
            ('lib/gen/c.generated.ts', 1, False, False, True, False, True, False, False, False),
            ('src/a.test.ts', 1, True, False, False, True, False, False, False, False),
            ('src/a.test.ts', 2, False, True, False, True, False, False, False, False),
            ('src/a.test.ts', 3, False, False, True, True, False, False, False, False),
            ('src/a.test.ts', 4, True, False, False, True, False, False, False, True),
            ('src/a.test.ts', 5, False, False, False, True, False, False, False, True),
            ('src/a.test.ts', 6, False, True, False, True, False, False, False, True),
            ('src/a.test.ts', 7, False, False, False, True, False, False, True, False),
            ('src/a.test.ts', 8, False, False, False, True, False, False, False, True),
        ],
    ),
    "structural_findings": (
        "path VARCHAR, rule_id VARCHAR, severity VARCHAR",
        [
            ('big.ts', 'large-file', 'info'),
            ('huge.ts', 'high-coupling', 'warning'),
            ('huge.ts', 'large-file', 'warning'),
            ('small.ts', 'dead-module', 'info'),
        ],
    ),
    "written_by_hand": (
        "path VARCHAR",
        [
            ('distance.ts',),
            ('src/a.ts',),
        ],
    ),
    "find_file": (
        "query VARCHAR, path VARCHAR",
        [
            ('app.tsx', 'src/app.tsx'),
            ('lib/api.ts', 'src/lib/api.ts'),
            ('src/app.tsx', 'src/app.tsx'),
            ('utton.tsx', 'src/components/Button.tsx'),
        ],
    ),
    "resolve_sources": (
        "path VARCHAR, source VARCHAR, dst VARCHAR",
        [
            ('a.ts', 'src/app.tsx', 'src/app.tsx'),
            ('src/app.test.ts', './app', 'src/app.tsx'),
            ('src/app.tsx', './lib/api', 'src/lib/api.ts'),
            ('src/app.tsx', './util', 'src/util/index.ts'),
            ('src/lib/api.ts', '../app', 'src/app.tsx'),
            ('src/lib/api.ts', '@/src/util', 'src/util/index.ts'),
        ],
    ),
    "importers_of": (
        "path VARCHAR",
        [
            ('src/app.test.ts',),
            ('src/lib/api.ts',),
        ],
    ),
    "find_symbol": (
        "path VARCHAR, line_no INT, kind VARCHAR, name VARCHAR",
        [
            ('cmd/main.go', 8, 'type', 'Server'),
            ('server/main.py', 7, 'class', 'Service'),
            ('server/models.py', 1, 'class', 'User'),
        ],
    ),
    "search_files": (
        "path VARCHAR, kind VARCHAR, total BIGINT, lines VARCHAR",
        [
            ('app/(shop)/items/[id]/page.tsx', 'path', 0, ''),
            ('app/api/items/route.ts', 'path', 0, ''),
            ('server/main.py', 'content', 2, '5,19'),
            ('src/app.test.ts', 'path', 0, ''),
            ('src/app.tsx', 'path', 0, ''),
            ('src/lib/api.ts', 'content', 1, '1'),
        ],
    ),
    "folder_listing": (
        "name VARCHAR, type VARCHAR",
        [
            ('A.md', 'blob'),
            ('B', 'tree'),
            ('a', 'tree'),
        ],
    ),
    "tree_order": (
        "path VARCHAR, type VARCHAR, parent VARCHAR, depth INT",
        [
            ('Z', 'tree', '', 1),
            ('a', 'tree', '', 1),
            ('a/d', 'tree', 'a', 2),
            ('b.ts', 'blob', '', 1),
        ],
    ),
    "tour_stops": (
        "path VARCHAR, points INT, start INT, end INT",
        [
            ('app/(shop)/items/[id]/page.tsx', 11, 1, 2),
            ('app/api/items/route.ts', 11, 1, 2),
            ('server/main.py', 10, 7, 21),
            ('src/app.tsx', 15, 5, 15),
            ('src/util/index.ts', 11, 1, 5),
        ],
    ),
    "project_overview": (
        "files BIGINT, lines BIGINT, has_tests BOOLEAN, has_config BOOLEAN, ext VARCHAR, folder VARCHAR, entries VARCHAR",
        [
            (14, 112, True, True, 'ts:4|tsx:3|md:2|py:2|go:1|json:1|rs:1', 'src:5|app:2|server:2|README.md:1|cmd:1|core:1|package.json:1|skills:1', 'src/app.tsx|src/util/index.ts|app/(shop)/items/[id]/page.tsx'),
        ],
    ),
    "pack_pins": (
        "reader VARCHAR, path VARCHAR, taken BOOLEAN",
        [
            ('a', 'README.md', True),
            ('a', 'server/main.py', False),
            ('a', 'server/models.py', True),
            ('a', 'src/lib/api.ts', True),
            ('b', 'README.md', False),
            ('b', 'src/app.test.ts', True),
            ('b', 'src/app.tsx', True),
            ('b', 'src/components/Button.tsx', False),
            ('b', 'src/lib/api.ts', False),
            ('b', 'src/util/index.ts', False),
        ],
    ),
    "skill_registry": (
        "path VARCHAR, id VARCHAR, name VARCHAR, tools VARCHAR, valid BOOLEAN, unique BOOLEAN",
        [
            ('s/a.md', 'Bad Id', 'x', '', False, True),
            ('s/b.md', 'code-review', 'Again', '', True, False),
            ('skills/review.md', 'code-review', 'Review', 'readFile|searchFiles', True, False),
        ],
    ),
    "findings_in_context": (
        "path VARCHAR, line_no INT, column_no INT, rule_id VARCHAR, severity VARCHAR, confidence VARCHAR",
        [
            ('src/docs/demo.js', 1, 0, 'eval-usage', 'critical', 'medium'),
            ('src/one.js', 1, 0, 'eval-usage', 'critical', 'high'),
            ('src/one.js', 10, 0, 'console-log', 'info', 'low'),
            ('src/one.js', 4, 0, 'eval-usage', 'critical', 'high'),
            ('src/one.js', 8, 2, 'innerhtml-xss', 'warning', 'low'),
            ('src/three.config.js', 1, 6, 'hardcoded-secret', 'critical', 'high'),
            ('src/three.config.js', 3, 6, 'insecure-random', 'warning', 'medium'),
            ('src/two.test.js', 2, 0, 'eval-usage', 'critical', 'medium'),
        ],
    ),
    "findings_over_lines": (
        "path VARCHAR, line_no INT, rule_id VARCHAR, severity VARCHAR, confidence VARCHAR, snippet VARCHAR",
        [
            ('src/four.py', 1, 'python-subprocess-shell', 'critical', 'high', 'subprocess.run('),
        ],
    ),
    "findings_in_order": (
        "path VARCHAR, line_no INT, rule_id VARCHAR, severity VARCHAR",
        [
            ('C.ts', 1, 'q', 'critical'),
            ('a.ts', 2, 'q', 'critical'),
            ('a.ts', 9, 'r', 'info'),
            ('b.ts', 1, 's', 'warning'),
        ],
    ),
    "composite_rules": (
        "path VARCHAR, line_no INT, rule_id VARCHAR, severity VARCHAR, confidence VARCHAR, cwe VARCHAR",
        [
            ('a.js', 2, 'composite-cmd-injection-exec-var', 'critical', 'medium', 'CWE-78'),
            ('a.js', 4, 'composite-cmd-injection-exec-var', 'critical', 'medium', 'CWE-78'),
            ('c.js', 1, 'express-no-helmet', 'info', 'low', 'CWE-693'),
            ('c.js', 2, 'express-no-rate-limit', 'info', 'medium', 'CWE-770'),
            ('c.js', 3, 'composite-csrf-missing-express', 'warning', 'medium', 'CWE-352'),
            ('c.js', 3, 'express-no-rate-limit', 'info', 'medium', 'CWE-770'),
            ('d.js', 2, 'composite-path-traversal-req', 'critical', 'medium', 'CWE-22'),
            ('g.ts', 1, 'composite-async-no-try-catch', 'info', 'low', 'CWE-390'),
            ('j.py', 2, 'composite-python-os-cmd', 'critical', 'medium', 'CWE-78'),
        ],
    ),
    "taint_flows": (
        "path VARCHAR, line_no INT, kind VARCHAR, source_line INT, rule_id VARCHAR",
        [
            ('a.js', 4, 'sql', 1, 'taint-sql'),
            ('a.js', 8, 'eval', 8, 'taint-eval'),
        ],
    ),
    "taint_with_options": (
        "path VARCHAR, line_no INT, kind VARCHAR, source_line INT, rule_id VARCHAR",
        [
            ('a.ts', 2, 'run', 1, 'taint-run'),
        ],
    ),
    "findings_cross_referenced": (
        "path VARCHAR, line_no INT, rule_id VARCHAR, severity VARCHAR, category VARCHAR, importers BIGINT, is_entry BOOLEAN, is_dead BOOLEAN, note VARCHAR",
        [
            ('a', 1, 'r', 'info', 'bad-practice', 0, False, True, ''),
            ('a', 2, 's', 'warning', 'security', 0, False, True, ''),
            ('hub', 1, 'r', 'info', 'reliability', 10, True, False, 'entry point; imported by 10 files'),
        ],
    ),
    "project_risk": (
        "repo VARCHAR, project_score DOUBLE",
        [
            ('a', 8.2),
            ('b', 0.0),
            ('c', 5.5),
        ],
    ),
    "security_grades": (
        "repo VARCHAR, security_points BIGINT, security_grade VARCHAR",
        [
            ('a', 94, 'A'),
            ('b', 89, 'B'),
            ('c', 35, 'F'),
            ('d', 100, 'A'),
            ('e', 34, 'F'),
        ],
    ),
    "accuracy_by_category": (
        "rule_id VARCHAR, tp BIGINT, fp BIGINT, missed BIGINT, category VARCHAR, fp_rate DOUBLE",
        [
            ('a', 2, 1, 0, 'security', 0.333),
            ('b', 0, 0, 3, 'style', 0.0),
            ('c', 0, 2, 0, None, 1.0),
        ],
    ),
    "issues_shown": (
        "id VARCHAR",
        [
            ('1',),
        ],
    ),
    "overflow_merged": (
        "rule_id VARCHAR, overflow BIGINT",
        [
            ('a', 7),
            ('b', 1),
            ('c', 4),
        ],
    ),
    "suggested_fixes": (
        "path VARCHAR, rule_id VARCHAR, new VARCHAR, diff VARCHAR",
        [
            ('a.js', 'eval-usage', 'var x = JSON.parse(y)', 'c1 one|r2 var x = eval(y)|a2 var x = JSON.parse(y)|c3 three'),
            ('a.js', 'var-usage', 'let x = eval(y)', 'c1 one|r2 var x = eval(y)|a2 let x = eval(y)|c3 three'),
            ('b.py', 'flask-debug-mode', 'app.run(debug=False)', 'r1 app.run(debug=True)|a1 app.run(debug=False)'),
        ],
    ),
    "finding_excerpts": (
        "path VARCHAR, line_no INT, excerpt VARCHAR",
        [
            ('a', 2, '       1 | x\n>>>    2 | y\n       3 | z'),
        ],
    ),
    "ai_verdicts": (
        "issue_id VARCHAR, verdict VARCHAR, confidence VARCHAR, reasoning VARCHAR, suggested_severity VARCHAR",
        [
            ('1', 'true-positive', 'high', 'yes', 'critical'),
            ('2', 'false-positive', 'low', 'No reasoning provided', None),
            ('3', 'false-positive', 'low', 'I think it is a false positive.', None),
            ('4', 'uncertain', 'low', 'no idea', None),
            ('5', 'uncertain', 'low', 'No reasoning provided', None),
        ],
    ),
    "scrubbed_secrets": (
        "id INT, t VARCHAR",
        [
            (1, 'k = "[REDACTED]"'),
            (2, 'Authorization: Bearer [REDACTED]'),
            (3, 'postgres://u:[REDACTED]@h/db'),
            (4, 'api_key=[REDACTED]'),
            (5, "x = 'plain-value-here'"),
            (6, "h = '[REDACTED]'"),
        ],
    ),
    "manifest_issues": (
        "repo VARCHAR, path VARCHAR, rule_id VARCHAR, severity VARCHAR, detail VARCHAR",
        [
            ('demo', 'package.json', 'deprecated-package', 'info', 'moment'),
            ('demo', 'package.json', 'git-dependency', 'info', 'forked'),
            ('demo', 'package.json', 'http-registry', 'warning', 'plain'),
            ('demo', 'package.json', 'no-lockfile', 'warning', ''),
            ('demo', 'package.json', 'overrides', 'info', 'resolutions'),
            ('demo', 'package.json', 'private-registry', 'info', 'https://own.test'),
            ('demo', 'package.json', 'star-version', 'warning', 'left'),
            ('demo', 'package.json', 'suspicious-script', 'warning', 'postinstall'),
        ],
    ),
    "workflow_issues": (
        "path VARCHAR, line_no INT, rule_id VARCHAR",
        [
            ('.github/workflows/ci.yml', 1, 'gha-dangerous-trigger'),
            ('.github/workflows/ci.yml', 2, 'gha-permissions-write-all'),
            ('.github/workflows/ci.yml', 3, 'gha-unpinned-action'),
            ('.github/workflows/ci.yml', 6, 'gha-script-injection'),
        ],
    ),
    "unpinned_requirements": (
        "path VARCHAR, line_no INT, text VARCHAR",
        [
            ('requirements.txt', 1, 'flask'),
            ('requirements.txt', 4, 'requests>=2'),
        ],
    ),
    "npmrc_issues": (
        "path VARCHAR, line_no INT, rule_id VARCHAR",
        [
            ('.npmrc', 3, 'npmrc-auth'),
            ('.npmrc', 5, 'http-registry'),
        ],
    ),
    "lockfile_integrity": (
        "path VARCHAR, missing BIGINT, first VARCHAR",
        [
            ('package-lock.json', 2, 'node_modules/a'),
        ],
    ),
    "manifest_dependencies": (
        "repo VARCHAR, pkg VARCHAR, version VARCHAR, is_dev BOOLEAN",
        [
            ('demo', 'axios', '1.4.0', False),
            ('demo', 'forked', 'git+https://x.test/a.git', False),
            ('demo', 'left', '*', False),
            ('demo', 'local', 'workspace:*', True),
            ('demo', 'moment', '2.29.1', True),
            ('demo', 'plain', 'http://x.test/a.tgz', False),
            ('demo', 'react', '17.0.0', True),
            ('demo', 'react', '18.2.0', False),
        ],
    ),
    "registry_dependencies": (
        "pkg VARCHAR, version VARCHAR",
        [
            ('a', '1.0'),
            ('f', '^2'),
        ],
    ),
    "osv_vulnerabilities": (
        "pkg VARCHAR, version VARCHAR, cve_id VARCHAR, summary VARCHAR, severity VARCHAR, fixed VARCHAR, reference VARCHAR, published VARCHAR",
        [
            ('a', '1.0', 'CVE-2020-1', 's', 'high', '1.2.3', 'https://c', None),
            ('a', '1.0', 'GHSA-2', 'No description available', 'medium', None, None, None),
            ('a', '1.0', 'GHSA-3', 'No description available', 'critical', None, 'https://d', None),
        ],
    ),
    "vulnerable_ranges": (
        "repo VARCHAR, pkg VARCHAR, version VARCHAR, id VARCHAR, fixed VARCHAR, severity VARCHAR",
        [
            ('r', 'a', '1.5.0', 'V1', '9.0', 'critical'),
            ('r', 'a', '10.1.0', 'V3', '10.2', 'high'),
            ('r', 'b', '2.0', 'V2', None, 'low'),
        ],
    ),
    "dependency_report": (
        "pkg VARCHAR, version VARCHAR, is_dev BOOLEAN, latest VARCHAR, downloads BIGINT, cves BIGINT, behind VARCHAR",
        [
            ('A', '2.0.0', True, '3.0.0', 9, 0, 'major'),
            ('b', '1.2.3', False, '1.3.0', 5, 2, 'minor'),
            ('c', '1.0', False, '1.0.0', 7, 0, None),
            ('d', '3.1.1', False, None, None, 0, None),
        ],
    ),
    "dependency_summary": (
        "total BIGINT, cves BIGINT, vulnerable BIGINT, major BIGINT, minor BIGINT, patch BIGINT, outdated BIGINT",
        [
            (4, 2, 1, 1, 1, 0, 2),
        ],
    ),
    "dependencies_sorted": (
        "pkg VARCHAR, downloads BIGINT",
        [
            ('A', 9),
            ('c', 7),
        ],
    ),
    "repository_dump": (
        "id BIGINT, owner VARCHAR, name VARCHAR, default_branch VARCHAR, stars BIGINT, forks BIGINT, is_fork BOOLEAN, parent_full_name VARCHAR, license VARCHAR",
        [
            (1, 'o', 'r', 'main', 5, 0, True, 'p/r', 'MIT'),
        ],
    ),
    "tree_dump": (
        "repo VARCHAR, tree_sha VARCHAR, ordinal INT, path VARCHAR, type VARCHAR, sha VARCHAR, size BIGINT",
        [
            ('r', 't', 0, 'a', 'tree', '1', 0),
            ('r', 't', 1, 'a/b.ts', 'blob', '2', 7),
        ],
    ),
    "commit_dump": (
        "repo VARCHAR, sha VARCHAR, message VARCHAR, author_name VARCHAR, at VARCHAR, author_login VARCHAR, n_parents INT",
        [
            ('r', 'c1', 'm', 'A', '2024-01-02 03:04', 'al', 2),
            ('r', 'c2', 'n', 'bot[bot]', None, None, 0),
        ],
    ),
    "human_commits": (
        "sha VARCHAR",
        [
            ('c3',),
        ],
    ),
    "comparison_dump": (
        "repo VARCHAR, status VARCHAR, ahead BIGINT, behind BIGINT, path VARCHAR, change VARCHAR, additions BIGINT, deletions BIGINT",
        [
            ('r', 'ahead', 2, 0, 'a.ts', 'modified', 3, 1),
            ('r', 'ahead', 2, 0, 'b.png', 'added', 0, 0),
        ],
    ),
    "change_stats": (
        "repo VARCHAR, files BIGINT, additions BIGINT, deletions BIGINT",
        [
            ('r', 2, 3, 1),
        ],
    ),
    "diff_lines": (
        "key VARCHAR, hunk INT, kind VARCHAR, old_line INT, new_line INT, text VARCHAR",
        [
            ('a.ts', 0, 'add', None, 1, 'new'),
            ('a.ts', 0, 'context', 2, 2, 'same'),
            ('a.ts', 0, 'del', 1, None, 'old'),
        ],
    ),
    "pull_dump": (
        "repo VARCHAR, number BIGINT, title VARCHAR, state VARCHAR, author VARCHAR, base VARCHAR, head VARCHAR, additions BIGINT, deletions BIGINT, changed_files BIGINT",
        [
            ('r', 7, 't', 'merged', 'al', 'main', 'f', 1, 2, 3),
        ],
    ),
    "ref_dump": (
        "repo VARCHAR, name VARCHAR, sha VARCHAR",
        [
            ('r', 'main', 's2'),
            ('r', 'v1', 's1'),
        ],
    ),
    "blame_dump": (
        "path VARCHAR, start_line INT, end_line INT, sha VARCHAR, author_email VARCHAR, author_login VARCHAR",
        [
            ('f', 1, 3, 'a', 'a@x', None),
            ('f', 4, 4, 'b', 'a@x', 'al'),
            ('f', 5, 6, 'c', None, None),
        ],
    ),
    "blame_owners": (
        "email VARCHAR, name VARCHAR, login VARCHAR, lines BIGINT, pct DOUBLE",
        [
            ('a@x', 'A', 'al', 4, 66.7),
            ('unknown', 'Unknown', None, 2, 33.3),
        ],
    ),
    "report_issues_markdown": (
        "repo VARCHAR, text VARCHAR",
        [
            ('r', '## Issues\n### Critical (1)\n- `a.ts:1` y\n### Warning (3)\n- `a.ts:5` x\n- `a.ts:6` x'),
        ],
    ),
    "report_repository_markdown": (
        "full_name VARCHAR, text VARCHAR",
        [
            ('r', '# r\n| URL | http://r |\n| Language | go |\n| Stars | 3 |\n- Files: 2\n- Lines: 40\n- Framework: None\n\n## Issues\n### Critical (1)\n- `a.ts:1` y\n### Warning (3)\n- `a.ts:5` x\n- `a.ts:6` x\n- `b.ts:2` x'),
        ],
    ),
    "report_summary_snippet": (
        "repo VARCHAR, text VARCHAR",
        [
            ('r', '**B** 3 issues: 0 critical, 2 warnings, 1 notes'),
        ],
    ),
    "report_json": (
        "repo VARCHAR, json VARCHAR",
        [
            ('r', '{"grade":"A","tags":["x","y"]}'),
        ],
    ),
    "report_compliance_json": (
        "json VARCHAR",
        [
            ('{"covered":66.7,"items":[{"item":"A01","n_rules":0,"n_issues":0,"status":"no-coverage"},{"item":"A02","n_rules":1,"n_issues":0,"status":"warn"},{"item":"A03","n_rules":4,"n_issues":0,"status":"pass"}]}',),
        ],
    ),
    "packages_by_category": (
        "category VARCHAR, pkg VARCHAR, importers BIGINT, place INT",
        [
            ('Other', 'lodash', 3, 1),
            ('UI Components', '@radix-ui/dialog', 1, 1),
            ('UI Framework', '+1 more', 2, 3),
            ('UI Framework', 'react', 5, 1),
            ('UI Framework', 'reactive-x', 4, 2),
            ('Validation', 'zod', 1, 1),
        ],
    ),
    "folders_adaptive": (
        "folder VARCHAR, files BIGINT, lines BIGINT, pct DOUBLE",
        [
            ('app', 2, 4, 3.6),
            ('cmd', 1, 18, 16.1),
            ('core', 1, 7, 6.3),
            ('server', 2, 25, 22.3),
            ('skills', 1, 7, 6.3),
            ('src', 5, 48, 42.9),
        ],
    ),
    "graph_common_stats": (
        "edges BIGINT, files BIGINT, avg_deps DOUBLE, most_imported VARCHAR, most_dependent VARCHAR",
        [
            (6, 14, 0.4, 'src/app.tsx', 'src/app.tsx'),
        ],
    ),
    "folder_roles": (
        "folder VARCHAR, files BIGINT, role VARCHAR",
        [
            ('lib', 2, 'regular'),
            ('src', 2, 'hub'),
            ('x', 1, 'entry'),
        ],
    ),
    "graph_health": (
        "project VARCHAR, note VARCHAR",
        [
            ('p', '1 circular dependency pair detected'),
            ('p', '2 connector files would split the graph'),
            ('p', '6 orphan files may be dead code'),
            ('p', 'deepest dependency chain is 9 levels'),
            ('r', '1 connector file would split the graph'),
            ('r', '1 file imported by more than 30% of the project'),
            ('r', '3 circular dependency pairs detected'),
        ],
    ),
    "boilerplate_paths": (
        "path VARCHAR, is_boilerplate BOOLEAN",
        [
            ('.github/x.yml', True),
            ('LICENSE', True),
            ('a/tsconfig.build.json', True),
            ('src/a.ts', False),
            ('sub/yarn.lock', True),
            ('x/.vscode/y', False),
        ],
    ),
    "fork_relations": (
        "a VARCHAR, b VARCHAR, parent VARCHAR",
        [
            ('a/r', 'b/r', 'o/r'),
            ('a/r', 'o/r', 'o/r'),
            ('b/r', 'o/r', 'o/r'),
            ('c/x', 'd/x', 'gone/x'),
            ('c/x', 'e/x', 'gone/x'),
        ],
    ),
    "repository_metrics": (
        "repo VARCHAR, files BIGINT, lines BIGINT, languages VARCHAR",
        [
            ('r', 3, 6, '{"go":2}'),
        ],
    ),
    "weighted_similarity": (
        "a VARCHAR, score DOUBLE, label VARCHAR, low_confidence BOOLEAN",
        [
            ('x', 1.0, 'likely-clone', False),
            ('y', 0.51, 'highly-similar', True),
            ('z', 0.125, 'different', False),
        ],
    ),
    "author_estimates": (
        "author VARCHAR, commits BIGINT, sessions BIGINT, minutes DOUBLE, active_days BIGINT, per_day DOUBLE, best_day VARCHAR, streak BIGINT",
        [
            ('a', 4, 3, 209.0, 2, 104.5, 'Monday', 2),
            ('b', 2, 2, 60.0, 2, 30.0, 'Sunday', 1),
        ],
    ),
    "author_pulse": (
        "minutes DOUBLE, contributors BIGINT, most_days BIGINT, session_minutes DOUBLE",
        [
            (120.0, 2, 9, 40.0),
        ],
    ),
    "relative_times": (
        "d VARCHAR, since VARCHAR, label VARCHAR",
        [
            ('2022-06-30', '2y', 'June 30, 2022'),
            ('2024-05-01', '2mo', 'May 1, 2024'),
            ('2024-06-29', '1d', 'Yesterday'),
            ('2024-06-30', 'today', 'Today'),
        ],
    ),
    "path_functions": (
        "folder VARCHAR, path VARCHAR, resolved VARCHAR, normal VARCHAR, id VARCHAR, short VARCHAR, top VARCHAR",
        [
            ('', 'a-b/c__d.ts', 'a-b/c__d.ts', 'a-b/c__d.ts', 'a_b_c_d_ts', '/.../c__d.ts', 'a-b'),
            ('a/b/c', 'd', 'a/b/c/d', 'a/b/c/d', 'd', 'a/.../d', 'd'),
            ('src', '../../up.ts', None, 'up.ts', 'up_ts', 'src/.../up.ts', '..'),
            ('src/lib', '../app/./x.ts', 'src/app/x.ts', 'src/app/x.ts', 'app_x_ts', 'src/.../x.ts', '..'),
        ],
    ),
    "number_functions": (
        "n BIGINT, short VARCHAR, cost VARCHAR, budget BIGINT",
        [
            (1000, '1K', '$0.50', 600),
            (1234, '1.2K', '$12.35', 740),
            (2500000, '2.5M', '$1.00', 1000000),
            (3000000, '3M', '$0.01', 1000000),
            (999, '999', '$0.0012', 599),
        ],
    ),
    "model_functions": (
        "id VARCHAR, name VARCHAR, price DOUBLE",
        [
            ('accounts/x/models/big', 'Big', 2.0),
            ('models/fast-model_2', 'Fast Model 2', 3.0),
            ('plain', 'Plain', None),
        ],
    ),
    "finding_vectors": (
        "vector VARCHAR",
        [
            ('S:critical/C:high/CAT:security/CWE:79',),
            ('S:info/C:low/CAT:style',),
            ('S:info/C:medium/CAT:style',),
        ],
    ),
    "repository_urls": (
        "url VARCHAR, owner VARCHAR, repo VARCHAR, branch VARCHAR, path VARCHAR, link VARCHAR",
        [
            ('github.com/o/r/tree/main/src/a', 'o', 'r', 'main', 'src/a', '/o/r?view=issues'),
            ('http://github.com/o', None, None, None, None, None),
            ('https://example.com/o/r', None, None, None, None, None),
            ('https://github.com/o/r.git', 'o', 'r', None, None, '/o/r?view=issues'),
            ('https://github.com/o/r/blob/dev/x.ts?a=1', 'o', 'r', 'dev', 'x.ts', '/o/r?view=issues'),
            ('o/r', 'o', 'r', None, None, '/o/r?view=issues'),
        ],
    ),
    "version_prefixes": (
        "v VARCHAR, bare VARCHAR",
        [
            ('5.0', '5.0'),
            ('=4', '4'),
            ('>=3', '3'),
            ('^1.2.3', '1.2.3'),
            ('~2.0', '2.0'),
        ],
    ),
    "diagram_flow": (
        "repo VARCHAR, text VARCHAR",
        [
            ('r', 'flowchart LR\n  b_ts["b"]\n  src_a_ts["a \'x\'"]:::hub\n  b_ts -->|2| src_a_ts\n  src_a_ts --> b_ts'),
        ],
    ),
    "diagram_classes": (
        "path VARCHAR, text VARCHAR",
        [
            ('src/app.tsx', "classDiagram\n  class Level {\n    <<enum>>\n    Low\n    High\n  }\n  class Mode {\n    <<type>>\n    'dark'\n    'light'\n  }\n  class Props {\n    <<interface>>\n    title: string\n    count?: number\n  }\n  Base <|-- Props\n  Named <|-- Props"),
        ],
    ),
    "diagram_pie": (
        "repo VARCHAR, text VARCHAR",
        [
            ('r', 'pie title Files\n  "py" : 9\n  "ts" : 3'),
        ],
    ),
    "scan_whole": (
        "phase INT, path VARCHAR, rule_id VARCHAR, severity VARCHAR, confidence VARCHAR, risk_score DOUBLE, n BIGINT, first_line INT",
        [
            (0, 'src/a.js', 'eval-usage', 'critical', 'high', 10.0, 1, 3),
            (0, 'src/c.py', 'python-assert-production', 'info', 'low', 1.0, 15, 1),
            (2, 'src/a.js', 'ast-empty-catch', 'warning', 'high', 6.0, 1, 4),
            (3, 'src/a.js', 'taint-eval', 'critical', 'high', 10.0, 1, 3),
            (3, 'src/a.js', 'taint-sql', 'critical', 'high', 10.0, 1, 2),
            (4, 'src/b.js', 'express-no-helmet', 'info', 'low', 2.5, 1, 1),
            (4, 'src/b.js', 'express-no-rate-limit', 'info', 'medium', 3.1, 1, 2),
        ],
    ),
    "scan_grades": (
        "files BIGINT, sloc BIGINT, total BIGINT, critical BIGINT, warning BIGINT, info BIGINT, points BIGINT, grade VARCHAR, security_grade VARCHAR, quality VARCHAR, project_score DOUBLE",
        [
            (3, 28, 21, 3, 1, 17, 0, 'F', 'F', 'F', 6.5),
        ],
    ),
    "scan_after_changes": (
        "path VARCHAR, rule_id VARCHAR, n BIGINT",
        [
            ('src/a.js', 'var-usage', 1),
            ('src/c.py', 'python-assert-production', 20),
        ],
    ),
}
