"""What to do about the findings of each code rule: advice, code that the rule finds, and code that does without it."""

_BIND = "Hand values over as bound parameters and keep them out of the statement."
_ARGV = "Start the program with a list of arguments and without a shell."
_INSIDE = "Resolve the path and check that it stays below an allowed folder."
_HOSTS = "Check the target against a list of allowed hosts first."
_STRONG = "Take a hash or cipher that still counts as strong."
_ENV = "Read the secret from the environment or a secret store."
_ESCAPE = "Write text through an interface that escapes it."
_CODE = "Don't run text as code; choose from known functions."
_SAFE_FORMAT = "Read a plain data format such as JSON."
_NO_ENTITIES = "Switch external entities and document types off before parsing."

ADVICE = {
    "xss_innerhtml": (_ESCAPE, "box.innerHTML = note;", "box.textContent = note;"),
    "xss_document_write": (_ESCAPE, "document.write(note);", "box.append(note);"),
    "command_injection_eval": (_CODE, "eval(rule)", "RULES[rule]()"),
    "sql_injection_string_format": (_BIND, "q = 'SELECT a FROM t WHERE k=' + key", "cur.execute('SELECT a FROM t WHERE k=?', [key])"),
    "sql_injection_fstring": (_BIND, "q = f'SELECT a FROM t WHERE k={key}'", "cur.execute('SELECT a FROM t WHERE k=?', [key])"),
    "sql_injection_raw_query": (_BIND, "cursor.execute('DELETE FROM t WHERE k=' + key)", "cursor.execute('DELETE FROM t WHERE k=?', [key])"),
    "sql_injection_raw_query_fstring": (_BIND, "cursor.execute(f'DELETE FROM t WHERE k={key}')", "cursor.execute('DELETE FROM t WHERE k=?', [key])"),
    "xss_template_safe": ("Let the template escape the value.", "{{ note | safe }}", "{{ note }}"),
    "xss_template_autoescape_off": ("Leave escaping on.", "{% autoescape off %}", "{% autoescape on %}"),
    "xss_markup": ("Escape the text, or clean it by a list of allowed elements.", "Markup(note)", "escape(note)"),
    "command_injection_os_system": (_ARGV, "os.system('tar xf ' + name)", "subprocess.run(['tar', 'xf', name], check=True)"),
    "command_injection_subprocess_shell": (_ARGV, "subprocess.run(line, shell=True)", "subprocess.run(['tar', 'xf', name])"),
    "command_injection_exec": (_CODE, "exec(rule)", "RULES[rule]()"),
    "path_traversal_open": (_INSIDE, "open(base + name)", "open(inside(base, name))"),
    "path_traversal_os_path_join": (_INSIDE, "os.path.join(base, user_input)", "inside(base, name)"),
    "insecure_pickle": (_SAFE_FORMAT, "pickle.loads(blob)", "json.loads(blob)"),
    "insecure_hash": (_STRONG, "hashlib.md5(blob)", "hashlib.sha256(blob)"),
    "insecure_random": ("Draw secrets from the operating system's generator.", "random.randint(0, 9)", "secrets.randbelow(10)"),
    "js_function_constructor": (_CODE, "const f = new Function(rule);", "const f = rules[rule];"),
    "js_child_process_exec": (_ARGV, "child_process (line); exec(line);", "run('tar', ['xf', name]);"),
    "js_dangerously_set_html": (_ESCAPE, "<p dangerouslySetInnerHTML={{__html: note}} />", "<p>{note}</p>"),
    "js_dynamic_require": ("Load modules by fixed names.", "const m = require(folder + name);", "const m = modules[name];"),
    "js_template_sql": (_BIND, "const q = `SELECT a FROM t WHERE k=${key}`;", "db.run('SELECT a FROM t WHERE k=?', [key]);"),
    "js_prototype_pollution": ("Keep keys in a map, or in an object without a prototype.", "o.__proto__.admin = true;", "const o = new Map();"),
    "js_dom_insert_adjacent": (_ESCAPE, "box.insertAdjacentHTML('beforeend', note);", "box.insertAdjacentText('beforeend', note);"),
    "java_sql_injection_string_concat": (_BIND, 'st.executeQuery("SELECT a FROM t WHERE k=" + key);', 'ps.setString(1, key);'),
    "java_sql_injection_statement_execute": (_BIND, "con.createStatement().executeQuery(q + key);", "ps.setString(1, key);"),
    "java_command_injection_runtime_exec": (_ARGV, "Runtime.getRuntime().exec(line);", "start(List.of(\"tar\", name));"),
    "java_command_injection_process_builder": (_ARGV, "new ProcessBuilder(line);", "start(List.of(\"tar\", name));"),
    "java_path_traversal_file_constructor": (_INSIDE, "new File(base, request);", "inside(base, name);"),
    "java_xxe_document_builder": (_NO_ENTITIES, "DocumentBuilderFactory.newInstance();", "hardenedBuilder();"),
    "java_xxe_sax_parser": (_NO_ENTITIES, "SAXParserFactory.newInstance();", "hardenedSax();"),
    "java_xxe_xmlinputfactory": (_NO_ENTITIES, "XMLInputFactory.newInstance();", "hardenedStax();"),
    "java_insecure_deserialization": (_SAFE_FORMAT, "new ObjectInputStream(in);", "mapper.readTree(in);"),
    "java_ssrf_url_connection": (_HOSTS, "new URL(request);", "allowed(address);"),
    "java_ldap_injection": ("Escape values that go into a directory filter.", 'ctx.search("cn=" + input);', "ctx.search(escaped(name));"),
    "java_xss_response_writer": (_ESCAPE, "res.getWriter().println(request);", "res.getWriter().println(escaped);"),
    "java_weak_crypto_md5_sha1": (_STRONG, 'MessageDigest.getInstance("MD5");', 'MessageDigest.getInstance("SHA-256");'),
    "java_weak_crypto_des_ecb": (_STRONG, 'Cipher.getInstance("AES/ECB/PKCS5Padding");', 'Cipher.getInstance("AES/GCM/NoPadding");'),
    "java_log_injection": ("Take line breaks out of what is logged.", "logger.info(request);", "logger.info(oneLine(text));"),
    "java_insecure_random": ("Draw secrets from SecureRandom.", "new Random();", "new SecureRandom();"),
    "java_hardcoded_password": (_ENV, 'String password = "swordfish";', 'String word = env("WORD");'),
    "go_sql_injection_sprintf": (_BIND, 'q := fmt.Sprintf("SELECT a FROM t WHERE k=%s", key)', 'db.Query("SELECT a FROM t WHERE k=?", key)'),
    "go_sql_injection_concat": (_BIND, "db.Query(q + key)", 'db.Query("SELECT a FROM t WHERE k=?", key)'),
    "go_command_injection_exec": (_ARGV, "exec.Command(tool + name)", 'exec.Command("tar", name)'),
    "go_command_injection_shell": (_ARGV, 'exec.Command("/bin/sh", "-c", line)', 'exec.Command("tar", name)'),
    "go_path_traversal": (_INSIDE, "os.Open(base + name)", "os.Open(inside(base, name))"),
    "go_path_traversal_http_dir": ("Serve a fixed folder.", "http.Dir(base + name)", 'http.Dir("public")'),
    "go_insecure_tls": ("Verify certificates.", "InsecureSkipVerify: true", "MinVersion: tls.VersionTLS12"),
    "go_ssrf": (_HOSTS, "http.Get(base + name)", "http.Get(allowed(name))"),
    "go_weak_crypto": (_STRONG, "md5.New()", "sha256.New()"),
    "go_text_template_unescaped": ("Take the template package that escapes HTML.", 'import "text/template"', 'import "html/template"'),
    "go_unsafe_deserialization": ("Limit and check what is read before it is decoded.", "gob.NewDecoder(r.Body)", "json.NewDecoder(limited)"),
    "go_hardcoded_password": (_ENV, 'password := "swordfish"', 'word := os.Getenv("WORD")'),
    "go_unhandled_error": ("Look at the error that comes back.", "rows, _ := db.Query(q)", "rows, err := db.Query(q)"),
    "rb_sql_injection_interpolation": (_BIND, 'User.where("k = #{key}")', "User.where(k: key)"),
    "rb_sql_injection_find_by_sql": (_BIND, 'User.find_by_sql("SELECT a WHERE k=#{key}")', "User.where(k: key)"),
    "rb_sql_injection_execute": (_BIND, 'con.execute("DELETE FROM t WHERE k=#{key}")', "User.where(k: key).delete_all"),
    "rb_command_injection_system": (_ARGV, 'system("tar xf #{name}")', 'system("tar", "xf", name)'),
    "rb_command_injection_backtick": (_ARGV, "out = `tar tf #{name}`", 'system("tar", "tf", name)'),
    "rb_command_injection_open3": ("Hand the program its arguments one by one.", "Open3.capture2(line)", 'run("tar", name)'),
    "rb_xss_raw": (_ESCAPE, "<%= raw note %>", "<%= note %>"),
    "rb_xss_html_safe": (_ESCAPE, "note.html_safe", "note"),
    "rb_insecure_yaml_load": ("Load plain values only.", "YAML.load(text)", "YAML.safe_load(text)"),
    "rb_insecure_marshal_load": (_SAFE_FORMAT, "Marshal.load(blob)", "JSON.parse(blob)"),
    "rb_mass_assignment_permit_all": ("Name the fields that a form may set.", "params.permit!", "params.permit(:name)"),
    "rb_open_redirect": ("Redirect to known places only.", "redirect_to params[:to]", "redirect_to home_path"),
    "rb_weak_crypto": (_STRONG, "Digest::MD5.hexdigest(blob)", "Digest::SHA256.hexdigest(blob)"),
    "rb_csrf_disabled": ("Leave the check of the form's token on.", "skip_before_action :verify_authenticity_token", "protect_from_forgery"),
    "rb_path_traversal_send_file": (_INSIDE, "send_file params[:name]", "send_file inside(base, name)"),
    "rb_dynamic_eval": (_CODE, "thing.instance_eval(rule)", "thing.public_send(known)"),
    "php_sql_injection_mysql_query": (_BIND, 'mysqli_query($c, "k=" . $key);', "$st->execute([$key]);"),
    "php_sql_injection_string_interpolation": (_BIND, '$db->query("SELECT a WHERE k=$key");', "$st->execute([$key]);"),
    "php_sql_injection_raw_expression": (_BIND, "$q->whereRaw($rule);", "$q->where('k', $key);"),
    "php_command_injection_functions": ("Escape each argument, or do without a program.", "shell_exec($line);", "run(['tar', $name]);"),
    "php_command_injection_backtick": ("Escape each argument, or do without a program.", "$out = `tar tf $name`;", "run(['tar', $name]);"),
    "php_xss_echo_superglobal": (_ESCAPE, "echo $_GET['note'];", "echo htmlspecialchars($note);"),
    "php_xss_blade_unescaped": (_ESCAPE, "{!! $note !!}", "{{ $note }}"),
    "php_file_upload_no_validation": ("Check kind, size and name of a file before it is kept.", "move_uploaded_file($_FILES['f']['tmp_name'], $to);", "store(checked($file));"),
    "php_eval_execution": (_CODE, "eval($rule);", "$rules[$name]();"),
    "php_preg_replace_eval": ("Replace with a callback.", "preg_replace('/a/e', $by, $text);", "preg_replace_callback('/a/', $f, $text);"),
    "php_ssrf_curl": (_HOSTS, "curl_setopt($h, CURLOPT_URL, $address);", "fetch(allowed($address));"),
    "php_ssrf_file_get_contents": (_HOSTS, "file_get_contents($address);", "fetch(allowed($address));"),
    "php_path_traversal_include": ("Include files by fixed names.", "include $page;", "include 'page.php';"),
    "php_insecure_unserialize": (_SAFE_FORMAT, "unserialize($blob);", "json_decode($blob);"),
    "php_weak_password_hash": ("Hash passwords with password_hash().", "md5($password);", "password_hash($word, PASSWORD_DEFAULT);"),
    "php_type_juggling": ("Compare with ===, and secrets with hash_equals().", "if ($token == $given) {}", "if (hash_equals($token, $given)) {}"),
    "php_info_disclosure_phpinfo": ("Leave it out of what is deployed.", "phpinfo();", "log_version();"),
    "php_info_disclosure_display_errors": ("Log errors and show none.", "ini_set('display_errors', 1);", "log_errors();"),
    "cs_sql_injection_string_concat": (_BIND, 'new SqlCommand("k=" + key);', 'cmd.Parameters.AddWithValue("@k", key);'),
    "cs_sql_injection_string_format": (_BIND, 'cmd.CommandText = $"k={key}";', 'cmd.Parameters.AddWithValue("@k", key);'),
    "cs_sql_injection_execute_concat": (_BIND, 'db.ExecuteReader("k=" + key);', 'cmd.Parameters.AddWithValue("@k", key);'),
    "cs_command_injection_process_start": (_ARGV, "Process.Start(tool + name);", "info.ArgumentList.Add(name);"),
    "cs_command_injection_process_filename": (_ARGV, "info.FileName = tool + name;", "info.ArgumentList.Add(name);"),
    "cs_path_traversal": (_INSIDE, "File.ReadAllText(root + name);", "Inside(root, name);"),
    "cs_xss_html_raw": (_ESCAPE, "@Html.Raw(note)", "@note"),
    "cs_xss_response_write": (_ESCAPE, "Response.Write(note);", "Show(Encode(note));"),
    "cs_insecure_deserialization_binary_formatter": (_SAFE_FORMAT, "new BinaryFormatter();", "JsonSerializer.Deserialize<Note>(text);"),
    "cs_insecure_deserialization_type_name_handling": ("Don't let the data name its types.", "TypeNameHandling = TypeNameHandling.All", "TypeNameHandling = TypeNameHandling.None"),
    "cs_insecure_deserialization_javascript_serializer": (_SAFE_FORMAT, "new JavaScriptSerializer();", "JsonSerializer.Deserialize<Note>(text);"),
    "cs_xxe_xml_document": (_NO_ENTITIES, "new XmlDocument();", "XmlReader.Create(stream, hardened);"),
    "cs_xxe_dtd_processing_parse": (_NO_ENTITIES, "s.DtdProcessing = DtdProcessing.Parse;", "s.DtdProcessing = DtdProcessing.Prohibit;"),
    "cs_ldap_injection": ("Escape values that go into a directory filter.", 'new DirectorySearcher("cn=" + name);', "Search(Escaped(name));"),
    "cs_weak_crypto": (_STRONG, "MD5.Create();", "SHA256.Create();"),
    "cs_weak_crypto_ecb_mode": ("Take an authenticated mode.", "aes.Mode = CipherMode.ECB;", "new AesGcm(key);"),
    "cs_hardcoded_connection_string": (_ENV, 'connectionString = "Server=a;Password=b"', 'Settings("db")'),
    "cs_insecure_cookie_httponly": ("Keep scripts away from the cookie.", "cookie.HttpOnly = false;", "cookie.HttpOnly = true;"),
    "cs_insecure_cookie_secure": ("Send the cookie over encrypted connections only.", "cookie.Secure = false;", "cookie.Secure = true;"),
    "cs_csrf_ignore": ("Leave the check of the form's token on.", "[IgnoreAntiforgeryToken]", "[ValidateAntiForgeryToken]"),
    "cs_open_redirect": ("Redirect to known places only.", "return Redirect(to + name);", "return LocalRedirect(to);"),
}
