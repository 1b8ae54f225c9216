"""The rule tables of the text scanners.

Every table below holds fixed values: names, patterns, kinds, severities, messages, confidences and weakness
numbers that define what the scanners report. Patterns are written in the syntax that Python and Java share.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    flags: str  # i: letters of either case; s: a dot is any character
    finding_type: str
    severity: str
    message: str
    confidence: float
    cwe_ids: tuple[str, ...] = ()

    @property
    def regex(self) -> str:
        return f"(?{self.flags}){self.pattern}" if self.flags else self.pattern


SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}

# Fixed values.
COMMON_RULES = (
    Rule("xss_innerhtml", r"\.innerHTML\s*=", "", "xss", "medium", "Potential XSS via innerHTML assignment.", 0.7, ("CWE-79",)),
    Rule("xss_document_write", r"document\.write\s*\(", "", "xss", "medium", "Potential XSS via document.write().", 0.7, ("CWE-79",)),
    Rule("command_injection_eval", r"""\beval\s*\(\s*(?!["']\s*\))""", "", "command_injection", "critical", 'Code execution risk via eval() with non-literal argument.', 0.7, ('CWE-94', 'CWE-95')),
)

# Fixed values.
PYTHON_RULES = (
    Rule("sql_injection_string_format", r"""(?:["'])\s*SELECT\s+.+?(?:\+\s*\w|%s["']\s*%\s*\w)""", "i", "sql_injection", "high", 'Possible SQL injection via string formatting in query construction.', 0.8, ('CWE-89',)),
    Rule("sql_injection_fstring", r"""f["'](?:[^"']*?)SELECT\s+.+?\{""", "i", "sql_injection", "high", 'Possible SQL injection via f-string in query construction.', 0.85, ('CWE-89',)),
    Rule("sql_injection_raw_query", r"""(?:cursor|conn(?:ection)?|db)\s*\.\s*execute\s*\(\s*["'].*?["']\s*\+""", "i", "sql_injection", "critical", 'SQL injection via unsanitized string concatenation in cursor.execute().', 0.9, ('CWE-89',)),
    Rule("sql_injection_raw_query_fstring", r"""(?:cursor|conn(?:ection)?|db)\s*\.\s*execute\s*\(\s*f["']""", "i", "sql_injection", "critical", 'SQL injection via f-string in cursor.execute().', 0.9, ('CWE-89',)),
    Rule("xss_template_safe", r"\|\s*safe\b", "", "xss", "high", "Potential XSS via |safe filter bypassing template auto-escaping.", 0.8, ("CWE-79",)),
    Rule("xss_template_autoescape_off", r"\{%\s*autoescape\s+off\s*%\}", "", "xss", "high", "Potential XSS via disabled auto-escaping in template.", 0.85, ("CWE-79",)),
    Rule("xss_markup", r"Markup\s*\(", "", "xss", "high", "Potential XSS via Markup() wrapping raw HTML.", 0.75, ("CWE-79",)),
    Rule("command_injection_os_system", r"os\.system\s*\(", "", "command_injection", "high", "Command injection risk via os.system().", 0.85, ("CWE-78",)),
    Rule("command_injection_subprocess_shell", r"subprocess\.(?:call|run|Popen|check_output|check_call)\s*\(.*shell\s*=\s*True", "", "command_injection", "high", "Command injection risk via subprocess with shell=True.", 0.8, ("CWE-78",)),
    Rule("command_injection_exec", r"""\bexec\s*\(\s*(?!["']\s*\))""", "", "command_injection", "critical", 'Code execution risk via exec() with non-literal argument.', 0.7, ('CWE-94', 'CWE-95')),
    Rule("path_traversal_open", r"""\bopen\s*\(\s*(?:\w+\s*\+|f["'])""", "", "path_traversal", "medium", 'Path traversal risk via open() with concatenated user input.', 0.6, ('CWE-22',)),
    Rule("path_traversal_os_path_join", r"os\.path\.join\s*\(.*(?:request|user_input|input|params|args|data)\b", "", "path_traversal", "medium", "Path traversal risk via os.path.join with potentially user-controlled path segment.", 0.5, ("CWE-22",)),
    Rule("insecure_pickle", r"pickle\.loads?\s*\(", "", "insecure_function", "high", "Insecure deserialization via pickle.load(s)() can execute arbitrary code.", 0.9, ("CWE-502",)),
    Rule("insecure_hash", r"hashlib\.(?:md5|sha1)\s*\(", "", "insecure_function", "low", "Use of weak hash algorithm (MD5/SHA1) which is unsuitable for security purposes.", 0.6, ("CWE-328",)),
    Rule("insecure_random", r"random\.(?:random|randint|choice|randrange|uniform)\s*\(", "", "insecure_function", "medium", "Use of non-cryptographic random number generator. Use secrets module for security.", 0.5, ("CWE-330",)),
)

# Fixed values.
JAVASCRIPT_RULES = (
    Rule("js_function_constructor", r"\bnew\s+Function\s*\(", "", "command_injection", "high", "Dynamic code generation via Function constructor.", 0.8, ("CWE-94", "CWE-95")),
    Rule("js_child_process_exec", r"(?:child_process|exec|execSync|spawn|spawnSync|execFile)\s*\(", "", "command_injection", "high", "Shell command execution in Node.js child_process.", 0.75, ("CWE-78",)),
    Rule("js_dangerously_set_html", r"dangerouslySetInnerHTML\s*=\s*\{", "", "xss", "high", "Unsafe HTML rendering via React dangerouslySetInnerHTML.", 0.85, ("CWE-79",)),
    Rule("js_dynamic_require", r"require\s*\(\s*(?:\w+\s*\+|`[^`]*\$\{)", "", "path_traversal", "medium", "Dynamic module loading with user-controlled path.", 0.65, ("CWE-22",)),
    Rule("js_template_sql", r"`[^`]*(?:SELECT|INSERT|UPDATE|DELETE|DROP)\s+[^`]*\$\{", "i", "sql_injection", "high", "SQL injection via template literal interpolation.", 0.85, ("CWE-89",)),
    Rule("js_prototype_pollution", r"__proto__\s*[\[.]", "", "insecure_pattern", "high", "Prototype pollution via __proto__ access.", 0.8, ("CWE-1321",)),
    Rule("js_dom_insert_adjacent", r"\.insertAdjacentHTML\s*\(", "", "xss", "medium", "DOM manipulation with potentially unsanitized HTML via insertAdjacentHTML.", 0.7, ("CWE-79",)),
)

# Fixed values.
JAVA_RULES = (
    Rule("java_sql_injection_string_concat", r"""(?:execute(?:Query|Update)?|prepareStatement)\s*\(\s*["'].*?["']\s*\+""", "i", "sql_injection", "critical", 'SQL injection via string concatenation in JDBC query.', 0.9, ('CWE-89',)),
    Rule("java_sql_injection_statement_execute", r"(?:Statement|createStatement)\s*\(\s*\)[\s\S]*?\.execute(?:Query|Update)?\s*\(\s*\w+\s*\+", "im", "sql_injection", "critical", "SQL injection via Statement with string concatenation.", 0.85, ("CWE-89",)),
    Rule("java_command_injection_runtime_exec", r"Runtime\s*\.\s*getRuntime\s*\(\s*\)\s*\.\s*exec\s*\(", "", "command_injection", "high", "Command injection risk via Runtime.exec().", 0.85, ("CWE-78",)),
    Rule("java_command_injection_process_builder", r"new\s+ProcessBuilder\s*\(", "", "command_injection", "medium", "Potential command injection via ProcessBuilder. Ensure arguments are not user-controlled.", 0.6, ("CWE-78",)),
    Rule("java_path_traversal_file_constructor", r"new\s+File\s*\(.*(?:request|param|input|user|getParameter|getHeader)\b", "i", "path_traversal", "high", "Path traversal risk via File constructor with user-controlled input.", 0.7, ("CWE-22",)),
    Rule("java_xxe_document_builder", r"DocumentBuilderFactory\s*\.\s*newInstance\s*\(\s*\)", "", "insecure_pattern", "high", "Potential XXE vulnerability. DocumentBuilderFactory defaults allow external entities.", 0.7, ("CWE-611",)),
    Rule("java_xxe_sax_parser", r"SAXParserFactory\s*\.\s*newInstance\s*\(\s*\)", "", "insecure_pattern", "high", "Potential XXE vulnerability via SAXParserFactory without secure configuration.", 0.7, ("CWE-611",)),
    Rule("java_xxe_xmlinputfactory", r"XMLInputFactory\s*\.\s*newInstance\s*\(\s*\)", "", "insecure_pattern", "high", "Potential XXE vulnerability via XMLInputFactory without secure configuration.", 0.7, ("CWE-611",)),
    Rule("java_insecure_deserialization", r"(?:ObjectInputStream|readObject|readUnshared)\s*\(", "", "insecure_function", "critical", "Insecure deserialization via ObjectInputStream can lead to remote code execution.", 0.85, ("CWE-502",)),
    Rule("java_ssrf_url_connection", r"new\s+URL\s*\(.*(?:request|param|input|user|getParameter|getHeader)\b", "i", "insecure_pattern", "high", "Potential SSRF via URL constructed from user-controlled input.", 0.7, ("CWE-918",)),
    Rule("java_ldap_injection", r"""(?:search|lookup)\s*\(.*["']\s*\+\s*(?:request|param|input|user|getParameter)""", "i", "sql_injection", "high", 'Potential LDAP injection via unsanitized user input in search filter.', 0.75, ('CWE-90',)),
    Rule("java_xss_response_writer", r"(?:getWriter|getOutputStream)\s*\(\s*\)\s*\.\s*(?:print(?:ln)?|write)\s*\(.*(?:request|param|getParameter|getHeader)\b", "i", "xss", "high", "Potential XSS via unsanitized user input written directly to HTTP response.", 0.8, ("CWE-79",)),
    Rule("java_weak_crypto_md5_sha1", r"""MessageDigest\s*\.\s*getInstance\s*\(\s*["'](?:MD5|SHA-?1)["']\s*\)""", "i", "insecure_function", "low", 'Use of weak hash algorithm (MD5/SHA-1) unsuitable for security purposes.', 0.7, ('CWE-328',)),
    Rule("java_weak_crypto_des_ecb", r"""Cipher\s*\.\s*getInstance\s*\(\s*["'](?:DES(?:/[^"']*)?|[^"']*/ECB(?:/[^"']*)?)["']\s*\)""", "i", "insecure_function", "high", 'Use of weak cipher (DES) or insecure block mode (ECB).', 0.85, ('CWE-327',)),
    Rule("java_log_injection", r"(?:log(?:ger)?|LOG)\s*\.\s*(?:info|warn|error|debug|trace|fatal)\s*\(.*(?:request|param|getParameter|getHeader|input)\b", "i", "insecure_pattern", "medium", "Potential log injection via unsanitized user input in log statement.", 0.6, ("CWE-117",)),
    Rule("java_insecure_random", r"new\s+(?:java\.util\.)?Random\s*\(", "", "insecure_function", "medium", "Use of java.util.Random for security-sensitive operations. Use SecureRandom instead.", 0.5, ("CWE-330",)),
    Rule("java_hardcoded_password", r"""(?:password|passwd|pwd|secret|apiKey|api_key)\s*=\s*["'][^"']{4,}["']""", "i", "secret", "high", 'Potential hardcoded password or secret in source code.', 0.7, ('CWE-798',)),
)

# Fixed values.
GO_RULES = (
    Rule("go_sql_injection_sprintf", r"""(?:fmt\.Sprintf|fmt\.Fprintf)\s*\([^)]*?(?:"|`)[^"`]*(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\s""", "i", "sql_injection", "critical", 'SQL injection via fmt.Sprintf in query construction. Use parameterized queries.', 0.9, ('CWE-89',)),
    Rule("go_sql_injection_concat", r"\.(?:Query|QueryRow|Exec|QueryContext|ExecContext)\s*\([^,)]*\+", "", "sql_injection", "critical", "SQL injection via string concatenation in database query.", 0.85, ("CWE-89",)),
    Rule("go_command_injection_exec", r"""exec\.Command\s*\(\s*(?:\w+\s*\+|fmt\.Sprintf|"[^"]*"\s*\+)""", "", "command_injection", "high", 'Command injection risk via exec.Command with dynamic arguments.', 0.8, ('CWE-78',)),
    Rule("go_command_injection_shell", r"""exec\.Command\s*\(\s*"(?:/bin/(?:ba)?sh|cmd(?:\.exe)?)"\s*,\s*"-c"\s*,""", "", "command_injection", "critical", 'Command injection risk via shell invocation with exec.Command.', 0.9, ('CWE-78',)),
    Rule("go_path_traversal", r"(?:os\.Open|os\.ReadFile|os\.WriteFile|os\.Create|ioutil\.ReadFile|ioutil\.WriteFile)\s*\(\s*(?:\w+\s*\+|fmt\.Sprintf|filepath\.Join\s*\([^)]*(?:request|req|params|query|input|user|r\.))", "", "path_traversal", "high", "Path traversal risk via file operation with user-controlled path.", 0.7, ("CWE-22",)),
    Rule("go_path_traversal_http_dir", r"http\.Dir\s*\(\s*(?:\w+\s*\+|fmt\.Sprintf)", "", "path_traversal", "high", "Path traversal risk via http.Dir with dynamic path.", 0.75, ("CWE-22",)),
    Rule("go_insecure_tls", r"InsecureSkipVerify\s*:\s*true", "", "insecure_pattern", "high", "TLS certificate verification disabled. Vulnerable to MITM attacks.", 0.95, ("CWE-295",)),
    Rule("go_ssrf", r"http\.(?:Get|Post|Head|PostForm)\s*\(\s*(?:\w+\s*\+|fmt\.Sprintf)", "", "insecure_pattern", "high", "Potential SSRF via HTTP request with user-controlled URL.", 0.7, ("CWE-918",)),
    Rule("go_weak_crypto", r"(?:md5|sha1)\.(?:New|Sum)\s*\(", "", "insecure_function", "low", "Use of weak hash algorithm (MD5/SHA1). Use SHA-256 or stronger for security.", 0.6, ("CWE-328",)),
    Rule("go_text_template_unescaped", r"text/template", "", "xss", "medium", "Use of text/template which does not escape HTML. Use html/template for web output.", 0.6, ("CWE-79",)),
    Rule("go_unsafe_deserialization", r"(?:gob|xml)\.NewDecoder\s*\(\s*(?:r\.Body|req\.Body|request\.Body|conn)", "", "insecure_function", "high", "Unsafe deserialization from untrusted source. Validate and limit input.", 0.7, ("CWE-502",)),
    Rule("go_hardcoded_password", '(?:password|passwd|secret|token|apiKey|api_key)\\s*(?::=|=)\\s*"[^"]{4,}"', "i", "secret", "high", 'Potential hardcoded credential in source code.', 0.7, ('CWE-798',)),
    Rule("go_unhandled_error", r"[a-zA-Z_]\w*\s*,\s*_\s*(?::=|=)\s*(?:\w+\.(?:Query|Exec|Open|Read|Write|Close|Get|Post|Do|Dial))\s*\(", "", "insecure_pattern", "medium", "Error return value discarded with '_'. Unhandled errors can mask security issues.", 0.6, ('CWE-391',)),
)

# Fixed values.
RUBY_RULES = (
    Rule("rb_sql_injection_interpolation", r"""\.(?:where|order|group|having|joins|select|from|pluck)\s*\(\s*["'].*#\{""", "i", "sql_injection", "critical", 'SQL injection via string interpolation in ActiveRecord query.', 0.9, ('CWE-89',)),
    Rule("rb_sql_injection_find_by_sql", r"""(?:find_by_sql|count_by_sql)\s*\(\s*["'].*#\{""", "", "sql_injection", "critical", 'SQL injection via string interpolation in find_by_sql/count_by_sql.', 0.9, ('CWE-89',)),
    Rule("rb_sql_injection_execute", r"""(?:execute|exec_query|exec_update|exec_delete|exec_insert)\s*\(\s*["'].*#\{""", "", "sql_injection", "critical", 'SQL injection via string interpolation in raw SQL execute.', 0.9, ('CWE-89',)),
    Rule("rb_command_injection_system", r"""\b(?:system|exec)\s*\(\s*["'].*#\{""", "", "command_injection", "critical", 'Command injection via string interpolation in system/exec call.', 0.9, ('CWE-78',)),
    Rule("rb_command_injection_backtick", r"`[^`]*#\{", "", "command_injection", "high", "Command injection via backtick execution with string interpolation.", 0.8, ("CWE-78",)),
    Rule("rb_command_injection_open3", r"Open3\.(?:capture2|capture2e|capture3|popen2|popen3|pipeline)\s*\(", "", "command_injection", "medium", "Potential command injection via Open3 shell execution.", 0.6, ("CWE-78",)),
    Rule("rb_xss_raw", r"<%=\s*raw\s+", "", "xss", "high", "Potential XSS via raw() bypassing Rails HTML escaping.", 0.85, ("CWE-79",)),
    Rule("rb_xss_html_safe", r"\.html_safe\b", "", "xss", "high", "Potential XSS via html_safe marking string as safe without sanitization.", 0.8, ("CWE-79",)),
    Rule("rb_insecure_yaml_load", r"YAML\.load\s*\(", "", "insecure_function", "critical", "Insecure deserialization via YAML.load can execute arbitrary code. Use YAML.safe_load.", 0.9, ("CWE-502",)),
    Rule("rb_insecure_marshal_load", r"Marshal\.(?:load|restore)\s*\(", "", "insecure_function", "critical", "Insecure deserialization via Marshal.load can execute arbitrary code.", 0.9, ("CWE-502",)),
    Rule("rb_mass_assignment_permit_all", r"\.permit\s*!\s*$", "m", "insecure_pattern", "high", "Mass assignment vulnerability via permit! allowing all parameters.", 0.9, ("CWE-915",)),
    Rule("rb_open_redirect", r"redirect_to\s+params\s*\[", "", "insecure_pattern", "medium", "Potential open redirect via redirect_to with user-controlled parameter.", 0.7, ("CWE-601",)),
    Rule("rb_weak_crypto", r"Digest::(?:MD5|SHA1)\b", "", "insecure_function", "low", "Use of weak hash algorithm (MD5/SHA1) unsuitable for security purposes.", 0.6, ("CWE-328",)),
    Rule("rb_csrf_disabled", r"skip_before_action\s+:verify_authenticity_token", "", "insecure_pattern", "high", "CSRF protection disabled via skip_before_action :verify_authenticity_token.", 0.9, ("CWE-352",)),
    Rule("rb_path_traversal_send_file", r"send_file\s+.*params\s*\[", "", "path_traversal", "high", "Path traversal risk via send_file with user-controlled parameter.", 0.8, ("CWE-22",)),
    Rule("rb_dynamic_eval", r"""\b(?:instance_eval|class_eval|module_eval)\s*\(\s*(?!["'][^"']*["']\s*\))""", "", "command_injection", "high", 'Code execution risk via instance_eval/class_eval/module_eval with dynamic argument.', 0.75, ('CWE-94', 'CWE-95')),
)

# Fixed values.
PHP_RULES = (
    Rule("php_sql_injection_mysql_query", r"(?:mysql_query|mysqli_query)\s*\([^)]*\.\s*\$", "i", "sql_injection", "critical", "SQL injection via string concatenation in mysql_query/mysqli_query.", 0.9, ("CWE-89",)),
    Rule("php_sql_injection_string_interpolation", r"""(?:mysql_query|mysqli_query|->query)\s*\([^)]*["'][^"']*\$""", "i", "sql_injection", "critical", 'SQL injection via variable interpolation in SQL query string.', 0.85, ('CWE-89',)),
    Rule("php_sql_injection_raw_expression", r"(?:DB::raw|whereRaw|selectRaw|orderByRaw|groupByRaw|havingRaw)\s*\([^)]*\$", "i", "sql_injection", "high", "SQL injection via Laravel raw expression with variable interpolation.", 0.85, ("CWE-89",)),
    Rule("php_command_injection_functions", r"\b(?:shell_exec|system|passthru|popen|proc_open)\s*\([^)]*\$", "i", "command_injection", "critical", "Command injection via PHP command execution function with variable input.", 0.9, ("CWE-78",)),
    Rule("php_command_injection_backtick", r"`[^`]*\$[^`]*`", "", "command_injection", "critical", "Command injection via PHP backtick operator with variable interpolation.", 0.85, ("CWE-78",)),
    Rule("php_xss_echo_superglobal", r"\becho\s+[^;]*\$_(?:GET|POST|REQUEST|COOKIE)\b", "i", "xss", "high", "XSS via direct echo of superglobal variable without escaping.", 0.9, ("CWE-79",)),
    Rule("php_xss_blade_unescaped", r"\{!!\s*.*\$.*!!\}", "", "xss", "high", "XSS via Laravel Blade unescaped output ({!! !!}).", 0.85, ("CWE-79",)),
    Rule("php_file_upload_no_validation", r"move_uploaded_file\s*\(\s*\$_FILES\b", "i", "insecure_function", "high", "File upload via move_uploaded_file() without apparent validation.", 0.75, ("CWE-434",)),
    Rule("php_eval_execution", r"\beval\s*\(\s*\$", "i", "command_injection", "critical", "Code execution via eval() with variable input.", 0.95, ("CWE-94", "CWE-95")),
    Rule("php_preg_replace_eval", r"""preg_replace\s*\(\s*['"](.)[^'"]*\1[a-z]*e[a-z]*['"]""", "i", "command_injection", "high", 'Code execution via preg_replace() with /e modifier.', 0.8, ('CWE-94',)),
    Rule("php_ssrf_curl", r"curl_setopt\s*\([^,]+,\s*CURLOPT_URL\s*,\s*\$", "i", "insecure_function", "high", "SSRF risk via curl_setopt with user-controlled URL.", 0.8, ("CWE-918",)),
    Rule("php_ssrf_file_get_contents", r"file_get_contents\s*\(\s*\$", "i", "insecure_function", "medium", "SSRF risk via file_get_contents() with user-controlled URL or path.", 0.7, ("CWE-918",)),
    Rule("php_path_traversal_include", r"\b(?:include|include_once|require|require_once)\s*\(?\s*\$", "i", "path_traversal", "critical", "Path traversal and code execution via include/require with variable input.", 0.9, ("CWE-22", "CWE-98")),
    Rule("php_insecure_unserialize", r"\bunserialize\s*\(\s*\$", "i", "insecure_function", "critical", "Insecure deserialization via unserialize() with variable input.", 0.9, ("CWE-502",)),
    Rule("php_weak_password_hash", r"\b(?:md5|sha1)\s*\(\s*\$(?:_POST|_GET|_REQUEST|pass|password)", "i", "insecure_function", "high", "Weak hash (md5/sha1) used for password hashing. Use password_hash() instead.", 0.85, ("CWE-328", "CWE-916")),
    Rule("php_type_juggling", r"\$(?:_POST|_GET|_REQUEST|_COOKIE|password|token|hash|secret|key|api_key)\b[^=!<>]*[^=!<>]==[^=]", "", "insecure_pattern", "medium", "Loose comparison (==) with sensitive variable may allow type juggling bypass.", 0.7, ("CWE-1025",)),
    Rule("php_info_disclosure_phpinfo", r"\bphpinfo\s*\(", "i", "insecure_function", "medium", "Information disclosure via phpinfo() exposes server configuration.", 0.9, ("CWE-200",)),
    Rule("php_info_disclosure_display_errors", r"""(?:ini_set|display_errors)\s*\(?[^)]*['\"]?(?:display_errors|1|on|true)['\"]?""", "i", "insecure_pattern", "low", 'Information disclosure via display_errors enabled in production.', 0.65, ('CWE-209',)),
)

# Fixed values.
CSHARP_RULES = (
    Rule("cs_sql_injection_string_concat", r"""(?:SqlCommand|SqlDataAdapter|OleDbCommand|OdbcCommand)\s*\([^)]*["']\s*\+""", "i", "sql_injection", "critical", 'SQL injection via string concatenation in SqlCommand constructor.', 0.9, ('CWE-89',)),
    Rule("cs_sql_injection_string_format", r"""(?:CommandText|SqlCommand|SqlDataAdapter)\s*[=(]\s*(?:string\.Format\s*\(|\$\s*["'])""", "i", "sql_injection", "critical", 'SQL injection via string interpolation or String.Format in SQL command.', 0.85, ('CWE-89',)),
    Rule("cs_sql_injection_execute_concat", r"""\.(?:ExecuteReader|ExecuteNonQuery|ExecuteScalar)\s*\([^)]*["']\s*\+""", "", "sql_injection", "critical", 'SQL injection via string concatenation passed to Execute method.', 0.9, ('CWE-89',)),
    Rule("cs_command_injection_process_start", r"""Process\.Start\s*\([^)]*(?:\+|\$["']|string\.Format)""", "i", "command_injection", "high", 'Command injection risk via Process.Start with dynamic arguments.', 0.8, ('CWE-78',)),
    Rule("cs_command_injection_process_filename", r"""\.(?:FileName|Arguments)\s*=\s*(?:\w+\s*\+|\$["']|string\.Format)""", "", "command_injection", "high", 'Command injection risk via dynamic ProcessStartInfo.FileName or Arguments.', 0.75, ('CWE-78',)),
    Rule("cs_path_traversal", r"""(?:Path\.Combine|File\.(?:ReadAllText|ReadAllBytes|WriteAllText|WriteAllBytes|Open|Copy|Move|Delete)|Directory\.(?:GetFiles|GetDirectories|Delete))\s*\([^)]*(?:\+|\$["'])""", "", "path_traversal", "high", 'Path traversal risk via file/directory operation with dynamic path.', 0.7, ('CWE-22',)),
    Rule("cs_xss_html_raw", r"Html\.Raw\s*\(", "", "xss", "high", "Potential XSS via Html.Raw() bypassing Razor auto-escaping.", 0.8, ("CWE-79",)),
    Rule("cs_xss_response_write", r"Response\.Write\s*\(", "", "xss", "medium", "Potential XSS via Response.Write() with unescaped output.", 0.7, ("CWE-79",)),
    Rule("cs_insecure_deserialization_binary_formatter", r"BinaryFormatter\s*\(", "", "insecure_function", "critical", "Insecure deserialization via BinaryFormatter can execute arbitrary code.", 0.95, ("CWE-502",)),
    Rule("cs_insecure_deserialization_type_name_handling", r"TypeNameHandling\s*[=:]\s*TypeNameHandling\.(?:All|Auto|Objects|Arrays)", "", "insecure_function", "critical", "Insecure deserialization via JsonConvert TypeNameHandling allows arbitrary type instantiation.", 0.9, ("CWE-502",)),
    Rule("cs_insecure_deserialization_javascript_serializer", r"JavaScriptSerializer\s*\(", "", "insecure_function", "high", "JavaScriptSerializer with type resolvers can lead to insecure deserialization.", 0.7, ("CWE-502",)),
    Rule("cs_xxe_xml_document", r"new\s+XmlDocument\s*\(", "", "insecure_pattern", "high", "Potential XXE vulnerability via XmlDocument without disabling DTD processing.", 0.7, ("CWE-611",)),
    Rule("cs_xxe_dtd_processing_parse", r"DtdProcessing\s*=\s*DtdProcessing\.Parse", "", "insecure_pattern", "critical", "XXE vulnerability: DtdProcessing.Parse enables external entity processing.", 0.95, ("CWE-611",)),
    Rule("cs_ldap_injection", r"""(?:DirectorySearcher|DirectoryEntry)\s*\([^)]*(?:\+|\$["']|string\.Format)""", "", "sql_injection", "high", 'LDAP injection via string concatenation in DirectorySearcher/DirectoryEntry.', 0.8, ('CWE-90',)),
    Rule("cs_weak_crypto", r"(?:MD5|SHA1|DES|TripleDES|RC2)\.Create\s*\(", "", "insecure_function", "medium", "Use of weak cryptographic algorithm (MD5/SHA1/DES/TripleDES/RC2).", 0.8, ("CWE-327", "CWE-328")),
    Rule("cs_weak_crypto_ecb_mode", r"CipherMode\.ECB", "", "insecure_function", "high", "Use of ECB cipher mode which does not provide semantic security.", 0.9, ("CWE-327",)),
    Rule("cs_hardcoded_connection_string", r"""(?:connectionString|ConnectionString|SqlConnection)\s*[=(]\s*["'](?=.*(?:Server|Data Source|Password|Pwd|Initial Catalog))""", "i", "secret", "high", 'Hardcoded connection string with potential credentials.', 0.8, ('CWE-798',)),
    Rule("cs_insecure_cookie_httponly", r"\.HttpOnly\s*=\s*false", "i", "insecure_pattern", "medium", "Cookie HttpOnly flag explicitly set to false, allowing client-side script access.", 0.85, ("CWE-1004",)),
    Rule("cs_insecure_cookie_secure", r"\.Secure\s*=\s*false", "i", "insecure_pattern", "medium", "Cookie Secure flag explicitly set to false, allowing transmission over HTTP.", 0.85, ("CWE-614",)),
    Rule("cs_csrf_ignore", r"\[IgnoreAntiforgeryToken\]", "", "insecure_pattern", "medium", "Anti-forgery token validation explicitly ignored, increasing CSRF risk.", 0.8, ("CWE-352",)),
    Rule("cs_open_redirect", r"""(?:Redirect|RedirectPermanent)\s*\(\s*(?:\w+\s*\+|\$["']|(?:Request|request)\s*[\[.])""", "", "insecure_pattern", "medium", 'Open redirect via dynamic URL in Redirect() potentially controlled by user input.', 0.7, ('CWE-601',)),
)

# The rules of each language name, beside the common ones.
LANGUAGE_RULES = {
    "python": PYTHON_RULES, "py": PYTHON_RULES, "javascript": JAVASCRIPT_RULES, "js": JAVASCRIPT_RULES,
    "typescript": JAVASCRIPT_RULES, "ts": JAVASCRIPT_RULES, "jsx": JAVASCRIPT_RULES, "tsx": JAVASCRIPT_RULES,
    "java": JAVA_RULES, "csharp": CSHARP_RULES, "cs": CSHARP_RULES, "go": GO_RULES, "golang": GO_RULES,
    "ruby": RUBY_RULES, "rb": RUBY_RULES, "php": PHP_RULES,
}

# Rules whose remedy can be applied without a person.
AUTO_FIXABLE = frozenset("""
    xss_template_safe insecure_hash java_weak_crypto_md5_sha1 java_insecure_random
    go_insecure_tls go_weak_crypto go_text_template_unescaped rb_insecure_yaml_load
    rb_weak_crypto php_xss_blade_unescaped php_type_juggling php_info_disclosure_phpinfo
    php_info_disclosure_display_errors cs_xxe_dtd_processing_parse cs_weak_crypto cs_weak_crypto_ecb_mode
    cs_insecure_cookie_httponly cs_insecure_cookie_secure cs_csrf_ignore
""".split())

# Fixed values.
PII_RULES = (
    Rule("email", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "", "pii_leak", "medium", 'Email address detected', 0.85, ('CWE-359',)),
    Rule("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "", "pii_leak", "critical", 'Social Security Number detected', 0.9, ('CWE-359',)),
    Rule("credit_card", r"\b(?:\d[ -]*?){13,19}\b", "", "pii_leak", "critical", 'Credit card number detected', 0.75, ('CWE-359',)),
    Rule("phone", r"(?:\+1[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?)\d{3}[\s.-]?\d{4}\b", "", "pii_leak", "medium", 'US phone number detected', 0.65, ('CWE-359',)),
    Rule("ip_address", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "", "pii_leak", "low", 'IPv4 address detected', 0.7, ('CWE-359',)),
    Rule("date_of_birth", r"(?i)(?:dob|date\s+of\s+birth|born\s+on)[:\s]+\d{1,2}/\d{1,2}/\d{4}", "", "pii_leak", "medium", 'Date of birth detected', 0.6, ('CWE-359',)),
    Rule("physical_address", r"\b\d{1,6}\s+[A-Za-z0-9.\s]+(?:Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Road|Rd|Lane|Ln|Way|Court|Ct|Circle|Cir|Place|Pl)\.?(?:\s*,\s*[A-Za-z\s]+,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?)?\b", "i", "pii_leak", "low", 'Physical address detected', 0.5, ('CWE-359',)),
)

# Fixed values.
PII_MASKS = {"email": "***@***.***", "ssn": "***-**-****", "credit_card": "****...****", "phone": "(***) ***-****", "ip_address": "***.***.***.***", "date_of_birth": "DOB: **/**/****", "physical_address": "*** [ADDRESS REDACTED]"}

# Fixed values.
INJECTION_RULES = (
    Rule("instruction_override", r"(?:ignore\s+(?:all\s+|previous\s+)instructions|disregard\s+(?:all\s+|previous\s+)(?:instructions|directives)|forget\s+your\s+instructions|override\s+(?:previous\s+|prior\s+)?instructions)", "i", "prompt_injection", "critical", "Attempt to override or nullify the model's existing instructions.", 0.9, ('CWE-77',)),
    Rule("role_hijacking", r"(?:you\s+are\s+now\b|act\s+as\b|pretend\s+to\s+be\b|roleplay\s+as\b|you\s+must\s+act\b)", "i", "prompt_injection", "high", "Attempt to reassign the model's role or persona.", 0.6, ('CWE-77',)),
    Rule("system_prompt_extraction", r"(?:show\s+(?:me\s+)?your\s+system\s+prompt|reveal\s+your\s+instructions|what\s+are\s+your\s+rules|print\s+your\s+prompt|display\s+your\s+(?:system\s+)?instructions|output\s+your\s+(?:system\s+)?prompt)", "i", "prompt_injection", "high", "Attempt to extract the model's system prompt or instructions.", 0.8, ('CWE-77',)),
    Rule("delimiter_abuse", r"(?:^|\n)(?:-{3,}|={3,}|\*{3,}|`{3,})(?:\s*\n)(?:-{3,}|={3,}|\*{3,}|`{3,})", "i", "prompt_injection", "medium", 'Suspicious use of repeated delimiters that may break prompt context.', 0.4, ('CWE-77',)),
    Rule("chatml_injection", r"(?:<\|system\|>|<\|user\|>|<\|assistant\|>|<\|endoftext\|>|\[INST\]|\[/INST\])", "i", "prompt_injection", "critical", 'ChatML or special token injection that may manipulate conversation structure.', 0.95, ('CWE-77',)),
    Rule("jailbreak_keywords", r"(?:\bDAN\b|\bjailbreak\b|do\s+anything\s+now|\bbypass\b\s*(?:filters?|restrictions?|safety|guidelines?|rules?)?|unrestricted\s+mode)", "i", "prompt_injection", "high", 'Jailbreak attempt to remove safety restrictions.', 0.7, ('CWE-77',)),
    Rule("information_extraction", r"(?:list\s+(?:all\s+)?(?:your\s+)?tools|show\s+(?:all\s+)?available\s+functions|what\s+tools\s+do\s+you\s+have|enumerate\s+your\s+capabilities|list\s+(?:all\s+)?available\s+(?:tools|functions|commands))", "i", "prompt_injection", "medium", "Attempt to enumerate the model's internal tools or capabilities.", 0.5, ('CWE-77',)),
    Rule("encoding_evasion", r"(?:decode\s+(?:this\s+)?base64|base64[\s\-_]*(?:decode|encoded?)|convert\s+(?:from\s+)?hex(?:adecimal)?|\brot13\b|hex[\s\-_]*(?:decode|encoded?)|decode\s+(?:this\s+)?hex)", "i", "prompt_injection", "medium", 'Attempt to use encoding schemes to evade content filters.', 0.5, ('CWE-77',)),
    Rule("instruction_tags", r"(?:\{\{SYSTEM\}\}|<<SYS>>|<</SYS>>|\[system\]|<system>|</system>|\[/system\])", "i", "prompt_injection", "high", 'Injection of instruction/system tags to manipulate prompt boundaries.', 0.85, ('CWE-77',)),
)

# Fixed values, by category.
CONTENT_RULES = {
    "violence": (
        Rule("instructions_to_kill", r"\b(?:how\s+to|instructions?\s+(?:for|to|on)|steps?\s+to|guide\s+to)\s+(?:kill|murder|assassinate|strangle|stab|shoot|dismember)\b", "i", "content_violation", "high", "instructions_to_kill", 0.8, ()),
        Rule("intent_to_harm", r"\b(?:i\s+(?:will|want\s+to|am\s+going\s+to|plan\s+to)|let'?s)\s+(?:kill|murder|assassinate|strangle|stab|shoot|attack|assault)\b", "i", "content_violation", "high", "intent_to_harm", 0.8, ()),
        Rule("encouraging_violence", r"\b(?:you\s+should|you\s+must|you\s+need\s+to|go\s+ahead\s+and)\s+(?:kill|murder|attack|assault|shoot|stab|strangle)\b", "i", "content_violation", "high", "encouraging_violence", 0.7, ()),
        Rule("best_methods_violence", r"\b(?:best\s+(?:way|method)s?\s+to\s+(?:kill|murder|torture|attack))\b", "i", "content_violation", "high", "best_methods_violence", 0.7, ()),
        Rule("weapon_construction", r"\b(?:make|build|construct|assemble)\s+(?:a\s+)?(?:bomb|explosive|ied|weapon)\b", "i", "content_violation", "high", "weapon_construction", 0.8, ()),
    ),
    "self_harm": (
        Rule("self_harm_instructions", r"\b(?:how\s+to|ways?\s+to|methods?\s+(?:of|to|for)|steps?\s+to|guide\s+to)\s+(?:kill\s+yourself|commit\s+suicide|end\s+(?:your|my)\s+life|hang\s+yourself|slit\s+(?:your|my)\s+wrists?|overdose)\b", "i", "content_violation", "critical", "self_harm_instructions", 0.9, ()),
        Rule("encouraging_self_harm", r"\b(?:you\s+should|you\s+deserve\s+to|just\s+go\s+ahead\s+and|why\s+don'?t\s+you)(?:\s+\w+){0,3}?\s+(?:kill\s+yourself|end\s+(?:your|it)\s+(?:all|life)|hurt\s+yourself|cut\s+yourself)\b", "i", "content_violation", "critical", "encouraging_self_harm", 0.9, ()),
        Rule("self_harm_best_methods", r"\b(?:best|easiest|most\s+painless|quickest|effective)\s+(?:way|method)s?\s+to\s+(?:die|end\s+(?:it|your\s+life)|kill\s+yourself|commit\s+suicide)\b", "i", "content_violation", "critical", "self_harm_best_methods", 0.8, ()),
        Rule("self_harm_intent", r"\b(?:i\s+(?:want\s+to|am\s+going\s+to|plan\s+to|will))\s+(?:kill\s+myself|end\s+my\s+life|hurt\s+myself|cut\s+myself|commit\s+suicide)\b", "i", "content_violation", "critical", "self_harm_intent", 0.9, ()),
        Rule("lethal_dosage_info", r"\b(?:lethal\s+dose|fatal\s+amount)\s+of\b", "i", "content_violation", "critical", "lethal_dosage_info", 0.8, ()),
    ),
    "illegal_activity": (
        Rule("drug_manufacturing", r"\b(?:how\s+to|instructions?\s+(?:for|to|on)|steps?\s+to|guide\s+to|recipe\s+(?:for|to))\s+(?:make|cook|synthesize|manufacture|produce)\s+(?:meth|methamphetamine|cocaine|crack|heroin|fentanyl|lsd|mdma|ecstasy)\b", "i", "content_violation", "high", "drug_manufacturing", 0.8, ()),
        Rule("hacking_instructions", r"\b(?:how\s+to|instructions?\s+(?:for|to|on)|steps?\s+to|guide\s+to)\s+(?:hack\s+into|break\s+into|compromise|exploit)\s+(?:someone'?s?|a\s+person'?s?|their|bank|email|account|system)\b", "i", "content_violation", "high", "hacking_instructions", 0.7, ()),
        Rule("fraud_instructions", r"\b(?:how\s+to|instructions?\s+(?:for|to|on)|steps?\s+to|guide\s+to)\s+(?:commit|perform|carry\s+out|execute)\s+(?:fraud|identity\s+theft|money\s+laundering|tax\s+evasion|credit\s+card\s+fraud|wire\s+fraud)\b", "i", "content_violation", "high", "fraud_instructions", 0.7, ()),
        Rule("forgery_instructions", r"\b(?:how\s+to|instructions?\s+(?:for|to|on)|steps?\s+to|guide\s+to)\s+(?:forge|counterfeit|fake)\s+(?:a\s+)?(?:documents?|passport|id|identity|money|currency|checks?|cheques?)\b", "i", "content_violation", "high", "forgery_instructions", 0.7, ()),
        Rule("theft_instructions", r"\b(?:how\s+to|instructions?\s+(?:for|to|on)|steps?\s+to|guide\s+to)\s+(?:steal|shoplift|rob|burglarize|loot)\b", "i", "content_violation", "high", "theft_instructions", 0.8, ()),
    ),
}

# Fixed values: (pattern, kind of tainted data).
PYTHON_SOURCES = (
    (r"\binput\s*\(", "user_input"),
    (r"\brequest\.args\b", "request_param"),
    (r"\brequest\.form\b", "request_param"),
    (r"\brequest\.data\b", "request_param"),
    (r"\brequest\.json\b", "request_param"),
    (r"\brequest\.values\b", "request_param"),
    (r"\brequest\.files\b", "request_param"),
    (r"\brequest\.cookies\b", "request_param"),
    (r"\brequest\.headers\b", "request_param"),
    (r"\brequest\.GET\b", "request_param"),
    (r"\brequest\.POST\b", "request_param"),
    (r"\brequest\.query_params\b", "request_param"),
    (r"\brequest\.path_params\b", "request_param"),
    (r"\bos\.environ\b", "env_var"),
    (r"\bos\.getenv\s*\(", "env_var"),
    (r"\.read\s*\(", "file_read"),
    (r"\.readlines?\s*\(", "file_read"),
    (r"\bjson\.loads?\s*\(", "external_data"),
    (r"\byaml\.(?:safe_)?load\s*\(", "external_data"),
)

# Fixed values: (pattern, kind of tainted data).
JS_SOURCES = (
    (r"\breq\.params\b", "request_param"),
    (r"\breq\.query\b", "request_param"),
    (r"\breq\.body\b", "request_param"),
    (r"\breq\.headers\b", "request_param"),
    (r"\breq\.cookies\b", "request_param"),
    (r"\bprocess\.env\b", "env_var"),
    (r"\.getElementById\s*\(.*\)\.value\b", "user_input"),
    (r"\.querySelector\s*\(.*\)\.value\b", "user_input"),
    (r"\bwindow\.location\b", "user_input"),
    (r"\bfs\.readFileSync\s*\(", "file_read"),
)

# Fixed values.
PYTHON_SINKS = (
    Rule('cursor.execute', r"(?:cursor|conn(?:ection)?|db|session)\s*\.\s*execute(?:many)?\s*\(", "", "sql_injection", "critical", 'cursor.execute', 0.0, ('CWE-89',)),
    Rule('os.system', r"\bos\.system\s*\(", "", "command_injection", "critical", 'os.system', 0.0, ('CWE-78',)),
    Rule('subprocess', r"\bsubprocess\.(?:call|run|Popen|check_output|check_call)\s*\(", "", "command_injection", "critical", 'subprocess', 0.0, ('CWE-78',)),
    Rule('exec', r"""\bexec\s*\(\s*(?![\"']\s*\))""", "", "command_injection", "critical", 'exec', 0.0, ('CWE-94',)),
    Rule('eval', r"""\beval\s*\(\s*(?![\"']\s*\))""", "", "command_injection", "critical", 'eval', 0.0, ('CWE-94',)),
    Rule('open', r"\bopen\s*\(", "", "path_traversal", "high", 'open', 0.0, ('CWE-22',)),
    Rule('os.path.join', r"\bos\.path\.join\s*\(", "", "path_traversal", "medium", 'os.path.join', 0.0, ('CWE-22',)),
    Rule('render_template_string', r"\brender_template_string\s*\(", "", "xss", "high", 'render_template_string', 0.0, ('CWE-79',)),
    Rule('Markup', r"\bMarkup\s*\(", "", "xss", "high", 'Markup', 0.0, ('CWE-79',)),
    Rule('make_response', r"\bmake_response\s*\(", "", "xss", "medium", 'make_response', 0.0, ('CWE-79',)),
)

# Fixed values.
JS_SINKS = (
    Rule('db.query', r"(?:db|connection|pool|client)\s*\.\s*query\s*\(", "", "sql_injection", "critical", 'db.query', 0.0, ('CWE-89',)),
    Rule('child_process.exec', r"child_process\s*\.\s*exec\w*\s*\(", "", "command_injection", "critical", 'child_process.exec', 0.0, ('CWE-78',)),
    Rule('execSync', r"\bexecSync\s*\(", "", "command_injection", "critical", 'execSync', 0.0, ('CWE-78',)),
    Rule('eval', r"\beval\s*\(", "", "command_injection", "critical", 'eval', 0.0, ('CWE-94',)),
    Rule('new Function', r"\bnew\s+Function\s*\(", "", "command_injection", "high", 'new Function', 0.0, ('CWE-94',)),
    Rule('innerHTML', r"\.innerHTML\s*=", "", "xss", "high", 'innerHTML', 0.0, ('CWE-79',)),
    Rule('document.write', r"\bdocument\.write\s*\(", "", "xss", "high", 'document.write', 0.0, ('CWE-79',)),
    Rule('res.send', r"\bres\.send\s*\(", "", "xss", "medium", 'res.send', 0.0, ('CWE-79',)),
    Rule('fs.writeFileSync', r"\bfs\.(?:readFileSync|writeFileSync|appendFileSync)\s*\(", "", "path_traversal", "high", 'fs.writeFileSync', 0.0, ('CWE-22',)),
)

# Paths of test files.
TEST_FILES = (
    r"(^|/)test_[^/]*\.py$",
    r"(^|/)[^/]*_test\.py$",
    r"(^|/)[^/]*_test\.go$",
    r"(^|/)[^/]*\.test\.[jt]sx?$",
    r"(^|/)[^/]*\.spec\.[jt]sx?$",
    r"(^|/)[^/]*_spec\.rb$",
    r"(^|/)tests/",
    r"(^|/)__tests__/",
    r"(^|/)spec/",
    r"(^|/)conftest\.py$",
    r"(^|/)test_helper\.rb$",
)

# Weaknesses of each category of the public ranking of 2021.
OWASP = {
    ("A03:2021", "Injection"): "CWE-77 CWE-78 CWE-79 CWE-89 CWE-90 CWE-91 CWE-94 CWE-95 CWE-96".split(),
    ("A01:2021", "Broken Access Control"): "CWE-22 CWE-23 CWE-36 CWE-73 CWE-200 CWE-269 CWE-284 CWE-285 CWE-352 CWE-601 CWE-732".split(),
    ("A07:2021", "Identification and Authentication Failures"): "CWE-259 CWE-287 CWE-798 CWE-1004".split(),
    ("A02:2021", "Cryptographic Failures"): "CWE-321 CWE-327 CWE-328 CWE-330 CWE-326 CWE-311 CWE-312 CWE-359".split(),
    ("A08:2021", "Software and Data Integrity Failures"): "CWE-502 CWE-915".split(),
    ("A05:2021", "Security Misconfiguration"): "CWE-611 CWE-776 CWE-209".split(),
    ("A10:2021", "Server-Side Request Forgery"): "CWE-918".split(),
    ("A04:2021", "Insecure Design"): "CWE-250 CWE-434".split(),
}
