"""A file system that Spark's workers open by name, for the tests of the data source."""

from pyarrow import fs as pafs


def opened(uri):
    """Another file system: paths below a root of its own. Each file that is opened is noted beside the tree."""
    base = uri.removeprefix("shelf://")

    class Noting(pafs.FileSystemHandler):
        inner = pafs.SubTreeFileSystem(base, pafs.LocalFileSystem())

        def get_type_name(self):
            return "shelf"

        def get_file_info(self, paths):
            return self.inner.get_file_info(paths)

        def get_file_info_selector(self, selector):
            return self.inner.get_file_info(selector)

        def open_input_stream(self, path):
            with open(f"{base}.opened", "a") as f:
                f.write(path + "\n")
            return self.inner.open_input_stream(path)

        def normalize_path(self, path):
            return path

        def _no(self, *_):
            raise OSError("read only")

        copy_file = create_dir = delete_dir = delete_dir_contents = delete_file = delete_root_dir_contents = move = open_append_stream = open_output_stream = open_input_file = _no

    return pafs.PyFileSystem(Noting()), ""
